"""Collecting, weekly tables, streams with late rows."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarifa.operators import clusters, prepare, ranks, studies
from tarifa.sources import ingest
from tarifa.sources.scrape import Checkpoint, collect_week, collect_weeks, crawl_all
from tarifa.streaming import events as E


def site(url):
    """Two categories of 23 and 3 products; one product page is missing, one category fails."""
    if url == "bad":
        raise OSError
    base, _, page = url.partition("?p=")
    n = {"a": 23, "b": 3}.get(base)
    if n is not None:
        at = int(page or 1) - 1
        return 200, " ".join(f"{base}/{i}" for i in range(at * 10, min(n, at * 10 + 10)))
    return (404, "") if url == "b/1" else (200, f"page of {url}")


def test_collecting_goes_on_where_it_stopped(tmp_path):
    bases, options = {"a": "a", "b": "b", "bad": "bad"}, {"sleep": lambda s: None}
    assert len(list(crawl_all(site, {"a": "a", "b": "b"}, str.split, **options))) == 26
    point = Checkpoint(str(tmp_path / "state.json"))
    asked = []

    def stops(url):
        asked.append(url)
        if url == "a/15":
            raise KeyboardInterrupt
        return site(url)

    parse = lambda url, page: {"url": url, "nom": page}
    with pytest.raises(KeyboardInterrupt):
        collect_week(stops, 1, bases, str.split, parse, str(tmp_path), point, **options)
    assert point.load()["1"]["a"].parsed == 10
    asked.clear()
    status = {s["category"]: s for s in collect_week(lambda u: asked.append(u) or site(u), 1, bases, str.split, parse, str(tmp_path), point, **options)}
    assert "a/9" not in asked and "a/10" in asked
    assert [status[c]["status"] for c in ("a", "b")] == ["done", "partial"] and status["b"]["n_failed"] == 1
    assert len(json.loads((tmp_path / "week_1" / "a.json").read_text())) == 23
    asked.clear()
    collect_week(lambda u: asked.append(u) or site(u), 1, {"a": "a"}, str.split, parse, str(tmp_path), point, **options)
    assert not asked
    point.reset(1)
    assert point.load() == {}
    pauses = []
    out = collect_weeks(site, 2, 3, {"b": "b"}, str.split, parse, str(tmp_path), point, pause=5.0, sleep=pauses.append)
    assert [s["week"] for s in out] == [2, 3] and 5.0 in pauses


def test_weeks_of_csv(spark, tmp_path):
    (tmp_path / "week_1").mkdir()
    (tmp_path / "week_1" / "a_clean.csv").write_text("nom,prix_tnd\nx,1.5\ny,2\n", encoding="utf-8-sig")
    (tmp_path / "week_1" / "b_clean.csv").write_text("nom,ram_go\nz,8\n")
    with pytest.warns(UserWarning, match="no file of c"):
        df, missing = ingest.one_week(spark, str(tmp_path), 1, ["a", "b", "c"])
    assert df.columns[0] == "categorie" and missing == ["c"] and df.count() == 3
    assert ingest.week_table(spark, str(tmp_path), "a", 7).count() == 0
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        ingest.one_week(spark, str(tmp_path), 7, ["a"])


def test_late_rows_are_kept_apart(spark, tmp_path):
    schema, source = "id long, ts timestamp", tmp_path / "in"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    def add(*rows):
        spark.createDataFrame([(i, pd.Timestamp(t).to_pydatetime()) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(str(source))

    run = lambda: E.split_late(read(), "ts", str(tmp_path / "out"), str(tmp_path / "point"), "1 day").awaitTermination()
    add((1, "2024-01-10"), (2, "2024-01-01"))
    run()
    add((3, "2024-01-09 12:00"), (4, "2024-01-08"), (5, "2024-02-01"))
    run()
    add((6, "2024-01-20"))
    run()
    ids = lambda name: sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / name)).collect())
    assert ids("on_time") == [1, 2, 3, 5] and ids("late") == [4, 6]


def test_upserts_touch_their_parts_alone(spark, tmp_path):
    schema, source, out = "id long, ts long, v string", tmp_path / "in", str(tmp_path / "out")
    for rows in ([(i, 1, "old") for i in range(200)], [(3, 2, "new"), (500, 1, "first"), (4, 0, "older")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        E.upsert_latest(spark.readStream.schema(schema).parquet(str(source)), out, ["id"], "ts", checkpoint=str(tmp_path / "point")).awaitTermination()
    got = {r["id"]: r["v"] for r in E.current(spark, out).collect()}
    assert len(got) == 201 and got[3] == "new" and got[4] == "old" and got[500] == "first"
    second = spark.read.parquet(f"{out}/__version=1").select("__bucket").distinct().count()
    assert second <= 3 and E.tidy(spark, out) >= 1
    assert {r["id"]: r["v"] for r in E.current(spark, out).collect()} == got


def test_neighbours_like_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"b{i % 3}", float(x), float(y), f"m{i % 4}") for i, (x, y) in enumerate(rng.integers(0, 40, (900, 2)))]
    rows += [(1000 + i, "b0", 5.0, 5.0, "m1") for i in range(50)] + [(2000, "lonely", 1.0, 1.0, "m1"), (2001, "b1", 1e6, 0.0, "m2")]
    df = spark.createDataFrame(rows, "id long, block string, x double, y double, maker string")
    for different in (None, "maker"):
        got = {}
        for r in ranks.nearest(df, df, "block", ["x", "y"], 4, different).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["distance"], 9)))
        for i, b, x, y, m in rows[::7] + rows[-3:]:
            near = sorted((((x - p) ** 2 + (y - q) ** 2) ** 0.5, j) for j, c, p, q, n in rows if c == b and j != i and not (different and n == m))[:4]
            assert sorted(got.get(i, [])) == [(k + 1, j, round(d, 9)) for k, (d, j) in enumerate(near)]


def test_quantiles_and_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(0, 5000, 3000)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in ranks.quantiles(df, ["g"], "v", (0.0, 0.3, 0.5, 1.0)).collect()}
    for g in "ab":
        want = np.quantile([v for h, v in rows if h == g], (0.0, 0.3, 0.5, 1.0))
        assert np.allclose(got[g], want)
    assert got["c"] == [1.0] * 4 and "d" not in got


def test_categories_are_prepared(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        ram = float(rng.choice([4, 8, 16]))
        rows.append((f"u{i}", f"n{i}", "televiseurs" if i % 3 == 0 else "pc_portables", 1 + i % 2, float(500 + 100 * ram + rng.integers(0, 50)), None if i % 10 == 0 else ram, 256.0, 15.0, "A" if i % 4 else "B", None if i % 8 == 1 else "win", float(i % 5), "x"))
    df = spark.createDataFrame(rows, "url string, nom string, categorie string, semaine int, prix_tnd double, ram_go double, stockage_go double, taille_ecran double, marque string, os_platform string, cpu_serie double, processeur string")
    assert prepare.irrelevant("televiseurs") == ["ram_go", "stockage_go"] and prepare.numeric_targets("pc_bureau") == ["ram_go", "stockage_go"]
    stable = prepare.stable_selection(df)
    assert "ram_go" not in stable["televiseurs"][0] and {"ram_go", "marque", "prix_tnd"} <= set(stable["pc_portables"][0])
    tidy, encoded, report = prepare.process_category(df.where("categorie = 'pc_portables'"), "pc_portables", stable["pc_portables"][0])
    assert report is None and tidy.count() == 80 and not set(encoded.columns) & {"url", "nom"}
    gaps = tidy.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in tidy.columns]).first().asDict()
    assert not any(gaps.values())
    assert all(f.dataType.simpleString() in ("double", "int", "bigint") for f in encoded.schema)


def test_weeks_are_built(spark, tmp_path):
    rows = [(f"u{i}", f"n{i}", "pc_bureau", 1 + i % 2, 900.0 + 10 * (i % 7), float(4 * (1 + i % 3)), 256.0, "A") for i in range(60)]
    df = spark.createDataFrame(rows, "url string, nom string, categorie string, semaine int, prix_tnd double, ram_go double, stockage_go double, marque string")
    summary = prepare.build_weeks(df, str(tmp_path))
    assert [s["clean_rows"] for s in summary] == [30, 30] and summary[0]["clean_cols"] == summary[1]["clean_cols"]
    assert spark.read.parquet(f"{tmp_path}/week_2/pc_bureau_encoded").count() == 30


def test_ward_finds_separate_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 9)])
    labels = studies.ward(x, 3)
    assert [len(set(labels[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(labels)) == 3


def plain_ward(x, k):
    """The greedy way: of all pairs the cheapest merge, again and again."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def test_ward_along_chains_is_the_greedy_one():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (7, 2), (40, 5), (60, 3)):
        x = rng.normal(size=(n, 2))
        label = studies.ward(x, k)
        assert {frozenset(map(int, np.flatnonzero(label == j))) for j in range(k)} == plain_ward(x, k)
    twice = np.repeat(x, 2, axis=0)
    one, two = studies.ward(x, 4, np.full(60, 2.0)), studies.ward(twice, 4)
    assert clusters.rand_index(pd.crosstab(np.repeat(one, 2), two).to_numpy()) == 1


def test_ward_check_leaves_no_row_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    spots = np.concatenate([rng.normal(c, 0.2, (80, 2)) for c in ((0, 0), (5, 0), (0, 6))])
    rows = [(i, "A", float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(1000 + i, None, float(i % 2 * 9), 1.0) for i in range(40)] + [(2000 + i, "S", 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, brand string, x double, y double")
    for most in (2000, 60):  # with cells too
        monkeypatch.setattr(studies, "MAX_WARD", most)
        got = {r["brand"]: r for r in studies.ward_check(df, ["brand"], ["x", "y"]).collect()}
        assert got["A"]["n"] == 240 and got["A"]["k"] == 3 and got["A"]["ari"] > 0.97
        assert got[None]["n"] == 40 and got[None]["k"] == 2 and got[None]["ari"] == 1 and (got["S"]["n"], got["S"]["k"], got["S"]["ari"]) == (5, 1, None)
