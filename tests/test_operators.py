import math
import random
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from irspark.functions import text as T
from irspark.functions.dates import norm_date, partial_date
from irspark.operators import diag, fusion, graph, hosts, judging, metrics, quality, rank, runs
from irspark.sources import sinks, tables
from irspark.streaming import hosts as stream_hosts
from irspark.streaming import ingest

RUN = "branch string, qid long, unit_id string, doc_id long, score double"


def lists(spark, seed=1, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randint(1, 4), f"{rng.randint(1, 30)}_p0", 0, rng.choice([0.1, 0.5, 0.9, None, float("nan")])) for _ in range(n)]
    return spark.createDataFrame([(b, q, u, int(u.split("_")[0]), s) for b, q, u, _, s in rows], RUN)


def test_ranked_counts_units_once(spark):
    r = runs.ranked(lists(spark)).toPandas()
    assert not r.duplicated(["branch", "qid", "unit_id"]).any() and r.score.notna().all()
    for _, g in r.groupby(["branch", "qid"]):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        assert list(zip(-g.score, g.unit_id)) == sorted(zip(-g.score, g.unit_id))


def test_rrf_equals_python(spark):
    r = runs.ranked(lists(spark))
    got = fusion.rrf(r, fusion.config(spark, {"x": ["a*2", "b"]}), 100).toPandas()
    p, want = r.toPandas(), {}
    for x in p.itertuples():
        w = {"a": 2.0, "b": 1.0}.get(x.branch)
        if w:
            s, best = want.get((x.qid, x.unit_id), (0.0, 10**9))
            want[x.qid, x.unit_id] = (s + w / (60 + x.rank), min(best, x.rank))
    for q in p.qid.unique():
        order = sorted((k for k in want if k[0] == q), key=lambda k: (-round(want[k][0], 12), want[k][1], k[1]))
        assert list(got[got.qid == q].sort_values("rank").unit_id) == [u for _, u in order]
    with pytest.raises(ValueError):
        fusion.complete(r, {"x": ["nope"]}, strict=True)


def test_rbo_equals_brute_force(spark):
    r = runs.ranked(lists(spark))
    got = diag.pairwise(r, "unit_id", 8).toPandas()
    p = r.toPandas().query("rank <= 8").sort_values("rank")
    for x in got.itertuples():
        a, b = (list(p[(p.branch == n) & (p.qid == x.qid)].unit_id) for n in (x.a, x.b))
        k = min(len(a), len(b))
        want = 0.1 * sum(0.9 ** (d - 1) * len(set(a[:d]) & set(b[:d])) / d for d in range(1, k + 1))
        assert math.isclose(x.rbo, want, abs_tol=1e-6) and math.isclose(x.jaccard, len(set(a) & set(b)) / len(set(a) | set(b)), abs_tol=1e-6)


def test_greedy_order_is_greedy(spark):
    r = runs.ranked(lists(spark))
    order = diag.greedy_order(r, "unit_id", ["a", "b", "c"], 5)
    p = r.toPandas().query("rank <= 5")
    sets = {b: set(zip(g.qid, g.unit_id)) for b, g in p.groupby("branch")}
    have = set()
    for i, b in enumerate(order):
        assert len(sets[b] - have) == max(len(sets[c] - have) for c in order[i:])
        have |= sets[b]


def test_with_tail(spark):
    base = spark.createDataFrame([(1, f"u{i}", i, i + 1) for i in range(6)], "qid long, unit_id string, doc_id long, rank long")
    top = spark.createDataFrame([(1, "u1", 1, 2, 0.5), (1, "u0", 0, 1, 0.1)], "qid long, unit_id string, doc_id long, rank long, score double")
    out = runs.with_tail(top, base, 2).orderBy("rank").toPandas()
    assert list(out.unit_id) == ["u1", "u0", "u2", "u3", "u4", "u5"] and list(out["rank"]) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("hot", [3, 10**6])
def test_ranks_of_hot_groups(spark, hot):
    rng = random.Random(4)
    p = pd.DataFrame({"g": [rng.choice(["x", "y", None]) for _ in range(600)], "v": [rng.choice([None, *range(40)]) for _ in range(600)]})
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "g string, v double")
    got = rank.tie_ranks(df, ["g"], "v", hot).toPandas()
    q = p.dropna(subset=["v"]).copy()
    q["r"] = q.groupby("g", dropna=False)["v"].rank(ascending=False, method="average") * 2
    want = {(g if isinstance(g, str) else None, int(v)): int(r) for g, v, r in q[["g", "v", "r"]].itertuples(index=False)}
    assert {(x.g, int(x.v)): int(x.rank2) for x in got.itertuples()} == want
    pl = rank.places(df.where("v is not null").withColumn("i", F.monotonically_increasing_id()), ["g"], "v", ["i"], hot).toPandas()
    for _, g in pl.groupby(pl.g.fillna("-")):
        g = g.sort_values("place")
        assert list(g.place) == list(range(1, len(g) + 1)) and list(g.v) == sorted(g.v, reverse=True)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    want = {x: min(s) for s in want.values() for x in s}
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intervals_and_pairs(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame([(b, int(q), float(rng.random())) for b in "ab" for q in range(30)], columns=["branch", "qid", "f2"])
    df = spark.createDataFrame(p)
    got = metrics.intervals(df, ["branch"], ["f2"]).toPandas().set_index("branch")
    x = np.sort(p[p.branch == "a"].f2.to_numpy())
    m = np.random.default_rng(0).choice(x, size=(20_000, 30), replace=True).mean(axis=1)  # another resampling of the same queries
    assert abs(got.loc["a", "low"] - np.percentile(m, 2.5)) < 0.02 and abs(got.loc["a", "high"] - np.percentile(m, 97.5)) < 0.02
    assert got.loc["a", "low"] < got.loc["a", "mean"] < got.loc["a", "high"]
    d = spark.range(3).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19_999).cast("long"))).alias("r"), "id").select(metrics.times(metrics.drawn(F.col("id"), F.col("r"))).alias("w"), "id", "r")
    stats = d.groupBy("id").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect()
    assert all(abs(s["m"] - 1) < 0.05 and abs(s["v"] - 1) < 0.1 for s in stats)
    pairs = d.groupBy("r").pivot("id", [0, 1, 2]).agg(F.first("w"))
    assert all(abs(pairs.select(F.corr(a, b)).first()[0]) < 0.03 for a, b in (("0", "1"), ("1", "2"), ("0", "2")))
    t = metrics.paired(df, "f2", "b").toPandas()
    assert list(t.branch) == ["a"] and 0 <= t.p[0] <= 1 and t.low[0] <= t["diff"][0] <= t.high[0]


def test_unit_hits(spark):
    run = spark.createDataFrame([("r", 1, "1_p0", 1, 1), ("r", 1, "1_p1", 1, 2), ("r", 1, "2_p0", 2, 3)], "branch string, qid long, unit_id string, doc_id long, rank long")
    gold = spark.createDataFrame([(1, "1_p0", 1, 2, "one two three four")], "qid long, unit_id string, doc_id long, grade int, text string")
    texts = spark.createDataFrame([("1_p0", "one two three four"), ("1_p1", "one x two y"), ("2_p0", "one two three four")], "unit_id string, text string")
    assert {r["unit_id"] for r in metrics.unit_hits(run, texts, gold).collect()} == {"1_p0", "1_p1"}


def test_tertiles_equal_quantile_cuts(spark):
    for n in (3, 4, 7, 10, 11, 50):
        x = spark.range(1, n + 1).withColumn("n", F.lit(n)).select(judging.tertile("n", "id").alias("t")).toPandas().t.tolist()
        assert x == pd.qcut(pd.Series(range(1, n + 1)), 3, labels=False).tolist()


def test_agreement_without_labels(spark):
    assert judging.agreement(spark.createDataFrame([], "item string, labeler string, tag string, grade long")).count() == 0


def test_dates(spark):
    cases = {"15/09/2026": "2026-09-15", "September 15, 2026": "2026-09-15", "2026年9月15日": "2026-09-15", "31/02/2020": None, "ngày 5 tháng 3 năm 2021": "2021-03-05", "1700000000": "2023-11-14", "2999-01-01": None, "": None, "12 Mar 2020 10:00": "2020-03-12", "x": None, "1700000000000": "2023-11-14"}
    df = spark.createDataFrame(list(cases.items()), "s string, want string").withColumn("got", norm_date(F.col("s"), F.lit("2026-09-14").cast("date")))
    assert df.where("not (got <=> want)").count() == 0
    p = spark.createDataFrame([("2020", "Mar", "5", "2020-03-05"), ("2020", "3", None, "2020-03"), ("2020", None, None, "2020"), (None, "3", None, None)], "y string, m string, d string, want string")
    assert p.where(~partial_date(F.col("y"), F.col("m"), F.col("d")).eqNullSafe(F.col("want"))).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("# A\n- b\n---\nc",)], "t string")
    assert df.select(T.to_plain(F.col("t"))).first()[0] == "A\nb\nc"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.tidy_path(F.array(*map(F.lit, ["Home", " › A", "A", "B", "T"])), F.lit("T"))) == "A > B"
    assert one(T.context(F.lit("T"), F.array(F.lit("T"), F.lit("x" * 101), F.lit("h")))) == "T > h"
    assert one(T.numbers_kept(F.lit("1,5 và 3"), F.lit("3 and 1.5"))) and not one(T.numbers_kept(F.lit("4"), F.lit("")))
    assert one(T.head_term(F.lit("tonsils (palatine); x"))) == "tonsils"
    assert one(T.host_matches(F.lit("a.b.c"), ["b.c"])) and not one(T.host_matches(F.lit("xb.c"), ["b.c"]))
    with pytest.raises(ValueError):
        T.in_shard(F.col("id"), 4, 4)


def test_quality_edges(spark):
    from irspark import schemas

    empty = spark.createDataFrame([], schemas.PAGES)
    assert quality.corpus(empty).count() == 0
    names = [c.split()[0] for c in schemas.PAGES.split(", ")]
    row = lambda **k: tuple(k.get(n) for n in names)
    rows = [row(id=1, status="ok", host="h", title="A - Site", text_hash="x", processed_at="1"), row(id=1, status="http_404", host="h", processed_at="2"), row(id=2, status="ok", host="h", title=None, text_hash="x"), row(id=3), row(id=None, status="ok")]
    out = quality.corpus(spark.createDataFrame(rows, schemas.PAGES)).toPandas().set_index("id")
    assert sorted(out.index) == [1, 2] and out.dup_of[2] == 1 and out.attempts[1] == 2 and out["flags"][2] == "dup"


def test_host_control_batch_and_stream(spark, tmp_path):
    c = hosts.Control.start(4, 1.0)
    for i in range(25):
        c = hosts.step(c, "good", i)
    assert c.limit == 3
    c = hosts.step(c, "throttle", 30)
    assert c.limit == 1 and hosts.step(c, "throttle", 31).delay == 2.0
    for i in range(3):
        c = hosts.step(c, "block", 40)
    assert c.strikes == 1 and c.pause_until == 340
    c = hosts.told_to_wait(hosts.Control.start(), 10, 5, 100)
    assert c.pause_until == 15 and c.delay == 1.5 and hosts.told_to_wait(hosts.Control.start(), 10, 5, 1).dead
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), float(i), rng.choice(["ok", "ok", "http_503", "blocked_captcha", "http_404"])) for i in range(300)]
    df = spark.createDataFrame(rows, "host string, at double, status string").coalesce(1)
    batch = hosts.fold(df).toPandas().set_index("host")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, at double, status string").parquet(str(tmp_path / "in"))
    q = stream_hosts.control(stream).writeStream.format("memory").queryName("hosts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    s = spark.table("hosts").toPandas().set_index("host")
    for h in "xyz":
        assert all(batch.loc[h, k] == s.loc[h, k] for k in ("limit", "delay", "strikes", "dead", "bad_run", "good_run"))


def test_ingest_stream(spark, tmp_path):
    from irspark import schemas

    names = [c.split()[0] for c in schemas.PAGES.split(", ")]
    rows = [tuple({"id": i, "status": "ok"}.get(n) for n in names) for i in range(5)]
    spark.createDataFrame(rows, schemas.PAGES).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # what was ingested isn't ingested again
        q = ingest.append(ingest.attempts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "url": "a"}\n\n{"id": 2, "url": "b"}\n')
    assert tables.links(spark, str(tmp_path / "l.jsonl")).count() == 2
    assert tables.ids(spark, "") is None and tables.ids(spark, "3, 1,3").count() == 2
    (tmp_path / "q.csv").write_text("qid,x\n1,a\n2,b\n2,c\n")
    assert tables.ids(spark, str(tmp_path / "q.csv")).count() == 2
    (tmp_path / "q.txt").write_text("1 2\n3,4\n")
    assert tables.ids(spark, str(tmp_path / "q.txt")).count() == 4
    head = "item,grade,note\n"
    (tmp_path / "sheet_pool_A.csv").write_text(head + "i1,2,\ni2,,\ni3,7,bad\n")
    (tmp_path / "sheet_ext1_A.csv").write_text(head + "i1,0,\n")
    got = tables.label_sheets(spark, str(tmp_path / "sheet_*.csv")).collect()
    assert [(r["item"], r["labeler"], r["tag"], r["grade"]) for r in got] == [("i1", "A", "pool", 2)]


def test_parts_are_read_once(spark, tmp_path):
    for d in ("s1", "s2"):
        (tmp_path / d / "pages").mkdir(parents=True)
        pd.DataFrame({"id": [1, 2]}).to_parquet(tmp_path / d / "pages" / "part-0.parquet")
    pd.DataFrame({"id": [3]}).to_parquet(tmp_path / "s2" / "pages" / "part-1.parquet")
    df = tables.parts(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")], "pages", "id long, url string")
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]


@pytest.mark.parametrize("size,n", [(1, 3), (3, 3), (10, 3), (11, 4), (100, 7)])
def test_spread(spark, size, n):
    got = sorted(r["id"] for r in tables.spread(spark.range(size).withColumn("g", F.lit(1)), "g", "id", n).collect())
    assert got == (list(range(size)) if size <= n else sorted({int((j + 0.5) * size / n) for j in range(n)}))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(q, r, "text " * 50 + str(r)) for q in (1, 2) for r in range(1, 41)], "qid long, rank long, text string")
    depth = sinks.submission(rows, str(tmp_path / "s.zip"), most_bytes=600)
    assert depth < 40 and zipfile.ZipFile(tmp_path / "s.zip").namelist() == ["submission.json"]
    sinks.run(spark.createDataFrame([(1, "u", 1, 1, 0.5)], "qid long, unit_id string, doc_id long, rank long, score double"), str(tmp_path / "run"))
    assert dict(spark.read.parquet(str(tmp_path / "run")).dtypes)["score"] == "float"
    assert Path(tmp_path / "run" / "_SUCCESS").exists()


def test_winners_bring_wide_rows_back(spark, tmp_path):
    """Only places of rows are sorted; rows of a frame that isn't read from files, and repeated rows, win once."""
    from irspark import schemas

    names = [c.split()[0] for c in schemas.PAGES.split(", ")]
    row = lambda **k: tuple(k.get(n) for n in names)
    rows = [row(id=1, status="http_404", xv=1, text="a"), row(id=1, status="ok", xv=1, text="b"), row(id=1, status="ok", xv=2, text="c"), row(id=1, status="ok", xv=2, text="c"), row(id=2, text="d"), row(id=None, status="ok")]
    df = spark.createDataFrame(rows, schemas.PAGES)
    df.write.parquet(str(tmp_path / "log"))
    for x in (df, spark.read.parquet(str(tmp_path / "log"))):
        out = quality.winners(x, "fetched_at")
        assert sorted((r["id"], r["text"], r["attempts"]) for r in out.collect()) == [(1, "c", 4), (2, "d", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


def _by_hand(postings, terms, k):
    sums = {}
    for q, t, f in terms:
        for u, w_t, w in postings:
            if w_t == t:
                sums[q, u] = sums.get((q, u), 0) + f * w
    out = []
    for q in {q for q, _, _ in terms}:
        best = sorted(((-round(s, 9), u) for (p, u), s in sums.items() if p == q and round(s, 9) > 0))[:k]
        out += [(q, u, i + 1, -s) for i, (s, u) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("weights", [(0.5,), (0.25, 0.5, 1.75, 1e-12)])
def test_search_makes_no_rows_of_pairs(spark, monkeypatch, weights):
    """Equal scores, terms of all and of few units, units in two rows, more query terms than are sent at once: the best as by hand, without a join."""
    from irspark.operators import bm25

    monkeypatch.setattr(bm25, "SENT_TERMS", 40)
    rng = random.Random(len(weights))
    postings = [(f"{u}_p0", t, rng.choice(weights)) for u in range(300) for t in ("all", f"t{u % 7}", f"r{u % 90}") if rng.random() < 0.9]
    postings += [("5_p0", "all", 0.5), ("\U0001d400_p0", "all", 1.75), ("\uffe0_p0", "all", 1.75)]
    terms = [(q, t, rng.randint(1, 2)) for q in range(30) for t in sorted({"all" if q % 3 else "none", f"t{q % 9}", f"r{q}"})]
    p, q = spark.createDataFrame(postings + [(None, "all", 9.0)], "unit_id string, term string, weight double"), spark.createDataFrame(terms, "qid long, term string, qtf long")
    out = bm25.search(p, q, 10)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["qid"], r["unit_id"], r["rank"], r["score"]) for r in out.collect()) == _by_hand(postings, terms, 10)
    assert bm25.search(p, q.where("qid < 0"), 10).count() == 0 and bm25.search(p.where("false"), q, 10).count() == 0
