"""K-means of units (a brand and tier, a segment), their number of clusters and their stability, for units of any size.

The steps are written once, as generators that ask for sums over a unit's rows and go on with the answer. A small unit answers within
one task. Large units are taken ``WAVE`` at a time: in each round the requests of all of them are answered by one pass over their rows,
so jobs grow with the number of steps and not with the number of units. Both ways give the same clusters: random draws are hashes of
the row's id, and coordinates lie on a grid of 2^-24, so that sums are exact in whatever order they are made.

* starts: k-means++, by the smallest exponential key over weight and squared distance (drawing in proportion to them);
* steps: until no centre moves, at most ``STEPS``; the best of ``STARTS`` starts;
* number of clusters: the best mean Euclidean silhouette among those whose smallest cluster is large enough. Of a large unit, tiles of
  its rows meet its rows in batches: each pair of rows is looked at, none are held;
* stability: refits on bootstrap replicates (rows weigh Poisson draws), compared by the adjusted Rand index of weighted tables.

Rows with equal coordinates are one point with a weight for each replicate in all but the draws, so work grows with the points.

A null feature counts as the unit's mean.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.sources.scratch import file_system, written, written_at

GRID, STARTS, REFIT_STARTS, STEPS, MAX_K = 2.0**-24, 10, 3, 100, 8
#: Large units worked on at once; rows of a tile of the silhouette; distances made at once; partial sums of a unit that reach the driver.
WAVE, TILE, ROOM, FAN = 256, 2048, 1 << 21, 16
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def uniform(h: np.ndarray, tag: int) -> np.ndarray:
    """A number between 0 and 1 for each row's hash and the tag."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((tag + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def weights(h: np.ndarray, replicate: int) -> np.ndarray:
    """How often each row is drawn in a replicate; -1: every row once."""
    return np.ones(len(h)) if replicate < 0 else np.searchsorted(_POISSON, uniform(h, (1 << 40) + replicate)).astype(float)


def on_grid(x: np.ndarray) -> np.ndarray:
    """Coordinates less their mean over their population deviation (0 for constant ones), on the grid."""
    with np.errstate(invalid="ignore"):
        known = ~np.isnan(x)
        n = np.maximum(known.sum(0), 1)
        mean = np.where(known, x, 0).sum(0) / n
        off = np.where(known, x - mean, 0.0)
        sd = np.sqrt((off * off).sum(0) / n)
    return np.rint(off / np.where(sd > 0, sd, 1) / GRID) * GRID


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres (whatever shape the latter are in before their last axis)."""
    flat = centres.reshape(-1, centres.shape[-1])
    return sum((x[:, [f]] - flat[:, f]) ** 2 for f in range(x.shape[1])).reshape(len(x), *centres.shape[:-1])


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, int)]
    for at in range(0, len(x), max(1, ROOM // max(1, len(centres)))):
        out.append(_squares(x[at : at + max(1, ROOM // max(1, len(centres)))], centres).argmin(1))
    return np.concatenate(out)


@dataclass
class Rows:
    """Rows of a unit: their points (distinct coordinates), and how often a replicate draws each row and each point."""

    x: np.ndarray
    h: np.ndarray

    def __post_init__(self):
        self._drawn: dict[int, np.ndarray] = {}
        self._weights: dict[int, np.ndarray] = {}
        order = np.lexsort(self.x.T[::-1]) if self.x.shape[1] else np.arange(len(self.x))
        new = np.ones(len(order), bool)
        new[1:] = (self.x[order[1:]] != self.x[order[:-1]]).any(1)
        self.of = np.empty(len(order), int)
        self.of[order] = np.cumsum(new) - 1
        self.points = self.x[order[new]]

    def drawn(self, replicate: int) -> np.ndarray:
        if replicate not in self._drawn:
            self._drawn[replicate] = weights(self.h, replicate).astype(np.uint8)
        return self._drawn[replicate]

    def weights(self, replicate: int) -> np.ndarray:
        if replicate not in self._weights:
            self._weights[replicate] = np.bincount(self.of, self.drawn(replicate), len(self.points))
        return self._weights[replicate]


@dataclass
class Points:
    """Points of a unit with their weights: of all rows once, then of each replicate."""

    points: np.ndarray
    counted: np.ndarray

    def weights(self, replicate: int) -> np.ndarray:
        return self.counted[:, replicate + 1]


# ---- requests: what is added up over a unit's rows


class Asked:
    def answer(self, x: np.ndarray, h: np.ndarray):
        return self.over(Rows(x, h))


@dataclass
class Pick(Asked):
    """For each combination (start, replicate) the row to be its next centre, given those it has."""

    combos: list[tuple[int, int]]
    centres: np.ndarray  # combinations x centres x features

    def over(self, held: Rows):
        x, h = held.x, held.h
        keys, rows = np.full(len(self.combos), np.inf), np.zeros((len(self.combos), x.shape[1]))
        if not len(x):
            return keys, rows
        have = self.centres.shape[1]
        for c, (start, replicate) in enumerate(self.combos):
            key = -np.log(uniform(h, ((replicate + 1) * 64 + start) * 64 + have))
            w = held.drawn(replicate).astype(float)
            if have:
                w = w * _squares(held.points, self.centres[c]).min(1)[held.of]
            key = np.where(w > 0, key / np.where(w > 0, w, 1), 1e250 * (1 + key))  # rows that are centres already, only if all are
            at = key.argmin()
            keys[c], rows[c] = key[at], x[at]
        return keys, rows

    def merge(self, a, b):
        first = (a[0] < b[0]) | ((a[0] == b[0]) & np.array([tuple(p) <= tuple(q) for p, q in zip(a[1], b[1])], bool))
        return np.where(first, a[0], b[0]), np.where(first[:, None], a[1], b[1])


@dataclass
class Step(Asked):
    """Weight, sums and loss of each cluster of each combination; by number of clusters."""

    parts: dict[int, tuple[list[int], np.ndarray]]  # k -> replicates, combinations x k x features

    def over(self, held: Rows | Points):
        x, out = held.points, {}
        for k, (replicates, centres) in self.parts.items():
            c, d = len(replicates), x.shape[1]
            counts, sums, loss = np.zeros((c, k)), np.zeros((c, k, d)), np.zeros(c)
            step = max(1, ROOM // (c * k))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                d2 = _squares(part, centres)
                label = d2.argmin(2)
                near = np.take_along_axis(d2, label[:, :, None], 2)[:, :, 0]
                drawn = {r: held.weights(r)[at : at + step] for r in set(replicates)}
                w = np.stack([drawn[r] for r in replicates], 1)
                cell = (label + np.arange(c) * k).ravel()
                counts += np.bincount(cell, w.ravel(), c * k).reshape(c, k)
                for f in range(d):
                    sums[:, :, f] += np.bincount(cell, (w * part[:, [f]]).ravel(), c * k).reshape(c, k)
                loss += (near * w).sum(0)
            out[k] = counts, sums, loss
        return out

    def merge(self, a, b):
        return {k: tuple(p + q for p, q in zip(a[k], b[k])) for k in a}


@dataclass
class Cross(Asked):
    """Weighted tables of the clusters of ``base`` against those of each combination."""

    base: np.ndarray
    replicates: list[int]
    centres: np.ndarray

    def over(self, held: Rows | Points):
        k = len(self.base)
        own = assign(held.points, self.base)
        return np.stack([np.bincount(own * k + assign(held.points, c), held.weights(r), k * k).reshape(k, k) for r, c in zip(self.replicates, self.centres)])

    def merge(self, a, b):
        return a + b


@dataclass
class Silhouettes(Asked):
    """Mean silhouette of the clusters around each set of centres; of the unit's rows, all pairs of them."""

    centres: dict[int, np.ndarray] = field(default_factory=dict)

    def of(self, x: np.ndarray, n: np.ndarray, others: Iterable[tuple[np.ndarray, np.ndarray]]) -> dict[int, float]:
        """Sum over the points ``x`` of ``n`` rows each of (b - a) / max(a, b), 0 for rows alone in their cluster; ``others`` are all points, in parts."""
        sums = {k: np.zeros((len(x), k)) for k in self.centres}
        sizes = {k: np.zeros(k) for k in self.centres}
        for part, times in others:
            step = max(1, ROOM // max(1, len(x)))
            for at in range(0, len(part), step):
                near, w = part[at : at + step], times[at : at + step]
                d = np.sqrt(_squares(x, near))
                for k, c in self.centres.items():
                    label = assign(near, c)
                    sizes[k] += np.bincount(label, w, k)
                    sums[k] += d @ (np.eye(k)[label] * w[:, None])
        out, rows = {}, np.arange(len(x))
        for k, c in self.centres.items():
            mine = assign(x, c)
            a = sums[k][rows, mine] / np.maximum(sizes[k][mine] - 1, 1)
            means = np.where(sizes[k] > 0, sums[k] / np.maximum(sizes[k], 1), np.inf)
            means[rows, mine] = np.inf
            b = means.min(1)
            out[k] = float((n * np.where(sizes[k][mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)).sum())
        return out

    def over(self, held: Rows):
        total, x, n = {k: 0.0 for k in self.centres}, held.points, held.weights(-1)
        for at in range(0, len(x), TILE):
            for k, s in self.of(x[at : at + TILE], n[at : at + TILE], [(x, n)]).items():
                total[k] += s
        return total


Request = Pick | Step | Cross | Silhouettes

# ---- the algorithms


def kmeans(d: int, ks: Sequence[int], starts: int = STARTS, replicates: Sequence[int] = (-1,)) -> Generator[Request, object, dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]]:
    """(k, replicate) -> centres in order, weight of each cluster, loss: the best of the starts. All k share the starts' rows."""
    combos = [(s, r) for r in replicates for s in range(starts)]
    first = np.zeros((len(combos), 0, d))
    for _ in range(max(ks)):
        _, rows = yield Pick(combos, first)
        first = np.concatenate([first, rows[:, None]], 1)
    now = {k: first[:, :k].copy() for k in ks}
    count, loss = {k: np.zeros((len(combos), k)) for k in ks}, {k: np.full(len(combos), np.inf) for k in ks}
    moving = {k: np.arange(len(combos)) for k in ks}
    for step in range(STEPS + 1):
        moving = {k: at for k, at in moving.items() if len(at)}
        if not moving:
            break
        found = yield Step({k: ([combos[c][1] for c in at], now[k][at]) for k, at in moving.items()})
        for k, (counts, sums, lost) in found.items():
            at = moving[k]
            count[k][at], loss[k][at] = counts, lost
            after = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1e-300)[:, :, None], now[k][at])
            moved = (after != now[k][at]).any((1, 2))
            if step < STEPS:
                now[k][at] = after
            moving[k] = at[moved]
    out = {}
    for i, r in enumerate(replicates):
        own = slice(i * starts, (i + 1) * starts)
        for k in ks:
            best = int(np.flatnonzero(loss[k][own] <= loss[k][own].min() * (1 + 1e-9) + 1e-12)[0]) + i * starts
            order = sorted(range(k), key=lambda j: tuple(now[k][best, j]))
            out[k, r] = now[k][best][order], count[k][best][order], float(loss[k][best])
    return out


def choose(n: int, d: int) -> Generator[Request, object, tuple[int, list[tuple], np.ndarray | None]]:
    """k of the best silhouette among those whose clusters are large enough (1 if none), a row per k tried, and the centres of that k."""
    ks = range(2, max(3, min(MAX_K, n // 10)) + 1)
    fits = yield from kmeans(d, ks)
    least = max(5, round(0.03 * n))
    full = {k: fits[k, -1][0][fits[k, -1][1] > 0] for k in ks}
    score = yield Silhouettes({k: c for k, c in full.items() if len(c) == k})
    best, best_s, trace = 1, -1.0, []
    for k in ks:
        _, sizes, loss = fits[k, -1]
        s = round(score[k] / n, 12) if k in score else None
        valid = s is not None and sizes.min() >= least
        trace.append((k, len(full[k]), int(sizes.min()) if len(full[k]) > 1 else 0, s, bool(valid), loss))
        if valid and s > best_s:
            best, best_s = k, s
    return best, trace, full[best] if best > 1 else None


def judged(n: int, d: int, replicates: int) -> Generator[Request, object, tuple[int, list[float]]]:
    """k and the adjusted Rand index of each bootstrap refit that has more than one cluster."""
    k, _, base = yield from choose(n, d)
    if base is None:
        return k, []
    every = list(range(replicates))
    fits = yield from kmeans(d, [k], REFIT_STARTS, every)
    tables = yield Cross(base, every, np.stack([fits[k, r][0] for r in every]))
    return k, [rand_index(t) for t in tables if (t.sum(0) > 0).sum() > 1]


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a table of (weighted) counts."""
    pairs = lambda v: (v * (v - 1) / 2).sum()
    cells, rows, cols, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), table.sum()
    chance = rows * cols / max(n * (n - 1) / 2, 1)
    best = (rows + cols) / 2
    return 1.0 if best == chance else float((cells - chance) / (best - chance))


# ---- who answers


def locally(asks: Generator, x: np.ndarray, h: np.ndarray):
    """The result over rows that one task holds."""
    held = Rows(x, h)
    try:
        request = next(asks)
        while True:
            request = asks.send(request.over(held))
    except StopIteration as end:
        return end.value


def _sent(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


@dataclass
class Large:
    """Units of any size: ``rows`` has unit (a number), id, h and x, ``points`` unit, x and w; under ``path`` each unit's points."""

    rows: DataFrame
    points: DataFrame
    path: str

    @classmethod
    def of(cls, df: DataFrame, names: DataFrame, keys: Sequence[str], features: Sequence[str], replicates: int = 0) -> Large:
        """``df`` has id, the keys and the features; ``names`` the keys and ``unit`` of ``WAVE`` units at most."""
        same = F.expr(" AND ".join(f"r.`{k}` <=> n.`{k}`" for k in keys))
        rows = df.alias("r").join(F.broadcast(names).alias("n"), same).select("n.unit", F.col("r.id").alias("id"), F.xxhash64("r.id").alias("h"), *[F.expr(f"r.`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(features)])
        rows = rows.withColumns({f"v{i}": F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i in range(len(features))})
        means = rows.groupBy("unit").agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(features))])
        rows = rows.join(F.broadcast(means), "unit")  # a row per unit of the wave
        rows = rows.withColumns({f"o{i}": F.coalesce(F.col(f"v{i}") - F.col(f"m{i}"), F.lit(0.0)) for i in range(len(features))})
        spread = rows.groupBy("unit").agg(*[F.sqrt(F.sum(F.col(f"o{i}") * F.col(f"o{i}")) / F.greatest(F.count(f"v{i}"), F.lit(1))).alias(f"s{i}") for i in range(len(features))])
        rows = rows.join(F.broadcast(spread), "unit")
        x = F.array(*[F.rint(F.col(f"o{i}") / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) / GRID) * GRID for i in range(len(features))])
        rows = written(rows.select("unit", "id", "h", x.alias("x")), "unit-rows")

        def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, h = batch.column("unit").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
                x = _sent(batch.column("x"), len(h))
                for u in np.unique(unit):
                    held = Rows(x[unit == u], h[unit == u])
                    w = np.stack([held.weights(r) for r in range(-1, replicates)], 1).astype(np.int64)
                    n = len(w)
                    yield pa.RecordBatch.from_pydict({"unit": pa.array(np.full(n, u, np.int32)), "x": pa.array(list(held.points), pa.list_(pa.float64())), "w": pa.array(list(w), pa.list_(pa.int64()))})

        points = rows.select("unit", "h", "x").mapInArrow(counted, "unit int, x array<double>, w array<long>")
        points = points.groupBy("unit", "x").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(replicates + 1)]).alias("w"))
        path, points = written_at(points, "units", ["unit"])
        return cls(rows, points, path)

    def run(self, asks: dict[int, Generator]) -> dict[int, object]:
        """The results of all units; each pass over the rows answers what all of them ask for."""
        out: dict[int, object] = {}
        asked: dict[int, Request] = {u: next(g) for u, g in asks.items()}
        while asked:
            answers = self._sums({u: q for u, q in asked.items() if not isinstance(q, Silhouettes)}) | self._silhouettes({u: q for u, q in asked.items() if isinstance(q, Silhouettes)})
            for u, a in answers.items():
                try:
                    asked[u] = asks[u].send(a)
                except StopIteration as end:
                    out[u] = end.value
                    del asked[u]
        return out

    def _sums(self, requests: dict[int, Request]) -> dict[int, object]:
        if not requests:
            return {}

        draws = {u: q for u, q in requests.items() if isinstance(q, Pick)}
        if len(draws) not in (0, len(requests)):
            return self._sums(draws) | self._sums({u: q for u, q in requests.items() if u not in draws})

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held: dict[int, object] = {}
            for batch in batches:
                unit = batch.column("unit").to_numpy()
                x = _sent(batch.column("x"), len(unit))
                more = batch.column("h").to_numpy().view(np.uint64) if draws else _sent(batch.column("w"), len(unit)).astype(float)
                for u in np.unique(unit):
                    if u in requests:
                        at = unit == u
                        a = requests[u].over(Rows(x[at], more[at]) if draws else Points(x[at], more[at]))
                        held[u] = requests[u].merge(held[u], a) if u in held else a
            n = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"unit": pa.array(list(held), pa.int32()), "part": pa.array([n % FAN] * len(held), pa.int32()), "sums": pa.array([pickle.dumps(v) for v in held.values()], pa.binary())})

        def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            total = None
            for blob in frame["sums"]:
                total = pickle.loads(blob) if total is None else requests[key[0]].merge(total, pickle.loads(blob))
            return pd.DataFrame({"unit": [key[0]], "part": [key[1]], "sums": [pickle.dumps(total)]})

        schema = "unit int, part int, sums binary"
        rows = (self.rows.select("unit", "h", "x") if draws else self.points.select("unit", "w", "x")).where(F.col("unit").isin(list(requests)))
        out: dict[int, object] = {}
        for r in sorted(rows.mapInArrow(part, schema).groupBy("unit", "part").applyInPandas(merge, schema).collect(), key=lambda r: (r["unit"], r["part"])):  # FAN rows a unit at most
            a = pickle.loads(r["sums"])
            out[r["unit"]] = requests[r["unit"]].merge(out[r["unit"]], a) if r["unit"] in out else a
        return out

    def _silhouettes(self, requests: dict[int, Silhouettes]) -> dict[int, dict[int, float]]:
        out: dict[int, dict[int, float]] = {u: {} for u, q in requests.items() if not q.centres}
        requests = {u: q for u, q in requests.items() if q.centres}
        if not requests:
            return out
        path = self.path

        def unit_points(u: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            fs, where = file_system(f"{path}/unit={u}")
            for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(where)) if f.path.endswith(".parquet")):
                for batch in pq.ParquetFile(f, filesystem=fs).iter_batches(1 << 14, columns=["x", "w"]):
                    yield _sent(batch.column("x"), batch.num_rows), _sent(batch.column("w"), batch.num_rows)[:, 0].astype(float)

        def tile(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            got = requests[key[0]].of(np.stack(frame["x"].to_numpy()), frame["n"].to_numpy(float), unit_points(key[0]))
            return pd.DataFrame({"unit": key[0], "k": list(got), "s": list(got.values())})

        points = self.points.where(F.col("unit").isin(list(requests)))
        tiles = points.groupBy("unit").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
        filed = points.join(F.broadcast(tiles), "unit").select("unit", "x", F.col("w")[0].alias("n"), F.pmod(F.xxhash64("x"), F.col("tiles")).alias("tile"))
        found = spread(filed, "unit", "tile").groupBy("unit", "tile").applyInPandas(tile, "unit int, k int, s double").groupBy("unit", "k").agg(F.sum("s").alias("s"))
        for r in found.collect():  # seven rows a unit
            out.setdefault(r["unit"], {})[r["k"]] = r["s"]
        return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys over as many tasks as a shuffle has: groups are small tables with long work, which must not be put into one task."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)
