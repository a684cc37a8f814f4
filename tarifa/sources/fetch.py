"""Fetching pages: retries with backoff, and a crawl of numbered listing pages.

The fetcher is a parameter (``url -> (status, html)``), so any client can be used; the tables that come out are ordinary
(url, html) rows for :mod:`tarifa.operators.html`.
"""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

Fetcher = Callable[[str], tuple[int, str]]


def fetch(fetcher: Fetcher, url: str, retries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, failures: Counter | None = None) -> str | None:
    """The page, or None after an error or another status than 200 at each try; waits double, with jitter.

    ``failures`` counts failed tries by what failed: the name of the error, or the status.
    """
    for n in range(retries + 1):
        try:
            status, html = fetcher(url)
            if status == 200:
                return html
            why = str(status)
        except Exception as e:  # noqa: BLE001  any failure of the client counts as a failed try
            why = type(e).__name__
        if failures is not None:
            failures[why] += 1
        if n < retries:
            sleep(wait * 2**n * (1 + random.random() / 2))  # noqa: S311
    return None


def crawl(fetcher: Fetcher, base: str, links: Callable[[str], Iterable[str]], most: int = 200, **options) -> Iterator[str]:
    """Product links of base, base?p=2, ...: until a page is missing or brings no new link, or ``most`` pages."""
    seen: set[str] = set()
    for n in range(1, most + 1):
        page = fetch(fetcher, base if n == 1 else f"{base}?p={n}", **options)
        new = [x for x in dict.fromkeys(links(page) if page else ()) if x not in seen]
        if not new:
            return
        seen.update(new)
        yield from new
