"""Collecting pages of a week: categories one after the other, resumable, with a status of each.

State is a small JSON file that is replaced as a whole (written beside it, then renamed), so that an interrupted run goes on where
it stopped: first with the list of links, then with the pages. The rows that come out are what ``ingest`` reads.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from tarifa.sources.fetch import Fetcher, crawl, fetch

#: Pages after which what was parsed so far is written.
EVERY = 10


@dataclass
class State:
    """What a run has done of one category: its links, how many of them are parsed, failures, and whether it is complete."""

    links: list[str] = field(default_factory=list)
    parsed: int = 0
    failed: list[str] = field(default_factory=list)
    done: bool = False


class Checkpoint:
    """States by week and category in one file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> dict[str, dict[str, State]]:
        """Empty without a file; a file that can't be read is an error, not an empty start."""
        if not self.path.exists():
            return {}
        raw = json.loads(self.path.read_text(encoding="utf-8"))
        return {w: {c: State(**s) for c, s in states.items()} for w, states in raw.items()}

    def save(self, states: dict[str, dict[str, State]]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        beside = self.path.with_suffix(".tmp")
        beside.write_text(json.dumps({w: {c: asdict(s) for c, s in own.items()} for w, own in states.items()}, ensure_ascii=False), encoding="utf-8")
        os.replace(beside, self.path)

    def reset(self, week: int | None = None) -> None:
        """Forget one week, or everything."""
        self.save({} if week is None else {w: s for w, s in self.load().items() if w != str(week)})


def crawl_all(fetcher: Fetcher, bases: Mapping[str, str], links: Callable[[str], Iterable[str]], **options) -> Iterator[tuple[str, str]]:
    """(category, link) of every category."""
    for category, base in bases.items():
        for link in crawl(fetcher, base, links, **options):
            yield category, link


def _write(rows: list[dict], path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_suffix(".tmp")
    beside.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    os.replace(beside, path)


def collect_category(fetcher: Fetcher, base: str, links: Callable[[str], Iterable[str]], parse: Callable[[str, str], dict | None], path: Path, state: State, save: Callable[[], None], **options) -> None:
    """Pages of one category into ``path`` (a JSON array); goes on from ``state``. A page that fails is noted and passed over."""
    if not state.links:
        state.links = list(crawl(fetcher, base, links, **options))
        save()
    rows = json.loads(path.read_text(encoding="utf-8")) if path.exists() and state.parsed else []
    for at in range(state.parsed, len(state.links)):
        url = state.links[at]
        page = fetch(fetcher, url, **options)
        row = parse(url, page) if page is not None else None
        if row is None:
            state.failed.append(url)
        else:
            rows.append(row)
        if (at + 1) % EVERY == 0 or at + 1 == len(state.links):
            _write(rows, path)
            state.parsed = at + 1
            save()
    state.done = True
    save()


def collect_week(fetcher: Fetcher, week: int, bases: Mapping[str, str], links, parse, root: str, checkpoint: Checkpoint, **options) -> list[dict]:
    """A status row per category: done, partial (some pages failed) or failed (with its error). Done ones are passed over."""
    states = checkpoint.load()
    own = states.setdefault(str(week), {})
    out = []
    for category, base in bases.items():
        state = own.setdefault(category, State())
        error = None
        if not state.done:
            try:
                collect_category(fetcher, base, links, parse, Path(root) / f"week_{week}" / f"{category}.json", state, lambda: checkpoint.save(states), **options)
            except Exception as e:  # noqa: BLE001  one category must not stop the others; its error is in the status
                error = f"{type(e).__name__}: {e}"
        status = "failed" if error else "done" if not state.failed else "partial"
        out.append({"week": week, "category": category, "status": status, "n_links": len(state.links), "n_parsed": state.parsed - len(state.failed), "n_failed": len(state.failed), "error": error})
    return out


def collect_weeks(fetcher: Fetcher, first: int, last: int, *args, pause: float = 7 * 86400, sleep: Callable[[float], None] = time.sleep, **options) -> list[dict]:
    """The weeks one after the other, with a pause between them."""
    out = []
    for week in range(first, last + 1):
        out += collect_week(fetcher, week, *args, **options)
        if week < last:
            sleep(pause)
    return out
