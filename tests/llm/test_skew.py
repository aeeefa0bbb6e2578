"""One key, source or group of copies holds a third of all rows: results stay whole."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from irspark.llm import borda, near, packing, repeats, topn
from test_problems import grams, repeated_lines, sentence, word


def test_hot_group_of_equal_scores(spark):
    rows = [("x", 1, f"u{i:05d}", 1.0) for i in range(6000)] + [("x", 2 + i % 300, f"u{i}", float(i % 17)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "branch string, qid long, unit_id string, score double").repartition(6)
    got = topn.top_n(spark, topn.cluster(df, ["branch", "qid"], "unit_id", "score", 8192), ["branch", "qid"], "unit_id", "score", 5).where("qid = 1").orderBy("place").collect()
    assert [r["unit_id"] for r in got] == [f"u{i:05d}" for i in range(5)]
    one = lambda **k: {(r["qid"], r["unit_id"]): (r["points2"], r["place"]) for r in borda.borda(df, **k).collect()}
    assert one(hot_rows=1000) == one()


def test_hot_source_and_line(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"h{i % 40}", "\n".join([sentence(rng), "The very same note of all", sentence(rng)])) for i in range(900)]
    got = {tuple(r) for r in repeats.found(spark.createDataFrame(rows, "id long, host string, text string")).collect()}
    assert got == repeated_lines(rows, 12)


SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_hot_class_of_copies(spark):
    rng = random.Random(2)
    base = [word(rng) for _ in range(60)]
    texts = [" ".join(base)] * 120 + [" ".join(word(rng) for _ in range(60)) for _ in range(240)]
    for i in range(130, 140):
        texts[i] = " ".join([*base[:50], *(word(rng) for _ in range(10))])
    m, p = near.near(spark.createDataFrame([(0, 0, i, 0, t) for i, t in enumerate(texts)], near.ROWS))
    members = {r["id"]: (r["rep"], r["copies"]) for r in m.collect()}
    assert all(members[i] == (0, 120) for i in range(120))
    pairs = {(r["a"], r["b"]) for r in p.collect()}
    g = {i: grams(texts[i]) for i in (0, *range(120, 360))}
    want = {(a, b) for a in g for b in g if a < b and 2 * len(g[a] & g[b]) >= len(g[a] | g[b])}
    assert pairs == want  # copies are compared once
    classes = defaultdict(set)
    for r in near.groups(m, p).collect():
        classes[r["class_id"]].add(r["id"])
    assert classes[0] == {*range(120), *range(130, 140)}


def test_versions_of_a_text_that_many_rows_copy(spark):
    rng = random.Random(3)
    base = [word(rng) for _ in range(60)]
    texts = [" ".join(base)] * 120 + [" ".join([*base[:45], *(word(rng) for _ in range(15))]) for _ in range(40)] + [" ".join(word(rng) for _ in range(60)) for _ in range(200)]
    g = {i: grams(texts[i]) for i in (0, *range(120, 360))}
    want = {(a, b) for a in g for b in g if a < b and 2 * len(g[a] & g[b]) >= len(g[a] | g[b])}
    assert len([1 for a, _ in want if a == 0]) == 40
    # paired where they meet, compared in blocks, and found by their rare sequences
    for how in ({"hot": 1000}, {"block": 8}, {"heavy": 8, "sampled": 1, "block": 8}):
        _, p = near.near(spark.createDataFrame([(0, 0, i, 0, t) for i, t in enumerate(texts)], near.ROWS), **how)
        got = {(r["a"], r["b"]) for r in p.collect()}
        assert got <= want and len(got) >= 0.98 * len(want) and len([1 for a, _ in got if a == 0]) >= 39


def test_texts_that_share_a_phrase(spark):
    """Every text has the phrases of all others, so that variants are hot; the pairs to find are few."""
    rng = random.Random(9)
    phrase = [word(rng) for _ in range(30)]
    texts = [" ".join(phrase + [word(rng) for _ in range(70)]) for _ in range(300)]
    texts += [" ".join(t.split()[:90] + [word(rng) for _ in range(10)]) for t in texts[:30]]
    g = [grams(t) for t in texts]
    want = {(a, b) for a in range(len(g)) for b in range(a + 1, len(g)) if 2 * len(g[a] & g[b]) >= len(g[a] | g[b])}
    assert len(want) == 30
    for how in ({}, {"hot": 4, "block": 16}, {"heavy": 20, "sampled": 1}):
        _, p = near.near(spark.createDataFrame([(0, 0, i, 0, t) for i, t in enumerate(texts)], near.ROWS), **how)
        assert {(r["a"], r["b"]) for r in p.collect()} == want


def test_near_pairs_need_no_more_than_the_disk_of_a_round(spark):
    """Shuffle files of a step are gone when it has ended, and neither rounds, slices nor wide variants change a pair."""
    rng = random.Random(10)
    phrase = [word(rng) for _ in range(30)]
    texts = [" ".join(phrase + [word(rng) for _ in range(50)]) for _ in range(200)]
    texts += [" ".join(t.split()[:72] + [word(rng) for _ in range(8)]) for t in texts[:40] * 2]
    rows = spark.createDataFrame([(0, 0, i, 0, t) for i, t in enumerate(texts)], near.ROWS)
    before = spark.conf.get(SHUFFLES, "false")
    out = []
    for how in ({}, {"rounds": 8, "most": 30}, {"heavy": 20, "sampled": 1, "rounds": 4}, {"heavy": 20, "sampled": 1, "wide": 24, "block": 16}):
        _, p = near.near(rows, **how)
        out.append({tuple(r) for r in p.collect()})
    assert len(out[0]) >= 80 and out.count(out[0]) == len(out)
    assert spark.conf.get(SHUFFLES, "false") == before
    # texts that many share a phrase with are exchanged as often as they have variants and not for every pair
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known = set(map(int, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.shuffleStatuses().keySet())))
    near.near(rows)
    left = set(map(int, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.shuffleStatuses().keySet()))) - known
    assert not left


def test_sets_meet_for_few_pairs_under_the_threshold(spark, monkeypatch):
    """Long texts with the same phrase fill the bits of the exchange, so that most pairs that meet are told by their classes."""
    rng = random.Random(12)
    phrase = [word(rng) for _ in range(260)]
    texts = [" ".join(phrase + [word(rng) for _ in range(640)]) for _ in range(60)]
    texts += [" ".join(t.split()[:800] + [word(rng) for _ in range(100)]) for t in texts[:10]]
    g = [grams(t) for t in texts]
    want = {(a, b) for a in range(len(g)) for b in range(a + 1, len(g)) if 2 * len(g[a] & g[b]) >= len(g[a] | g[b])}
    assert len(want) == 10
    met, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, sets: (met.append(pairs.count()), verified(pairs, sets))[1])
    _, p = near.near(spark.createDataFrame([(0, 0, i, 0, t) for i, t in enumerate(texts)], near.ROWS))
    assert {(r["a"], r["b"]) for r in p.collect()} == want
    assert sum(met) <= 2 * len(want)


def test_classes_keep_every_pair_over_the_threshold():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in (1, 1, 2, 15, 16, 17, 120, 130, 900, 1030, 5000) for _ in range(3)]
    sets += [np.unique(np.append(x[: max(1, int(len(x) * part))], rng.integers(0, 1 << 48, int(len(x) * more), dtype=np.uint64))) for x in sets for part, more in ((0.51, 0), (0.7, 0.05), (1, 0.9), (0.3, 0.5))]
    size = np.array([len(x) for x in sets])
    c = near._classes(np.concatenate(sets), size)
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets)), indexing="ij"))
    ok = (size[i] <= 2 * size[j]) & (size[j] <= 2 * size[i])
    i, j = i[ok], j[ok]
    t = pa.table({"tab": pa.array([0] * len(i), pa.int32()), "a": i, "b": j, "na": size[i], "nb": size[j], "ca": c.take(pa.array(i)), "cb": c.take(pa.array(j))})
    for x in "ab":
        t = t.append_column(f"size{x}", pa.array([len(v.as_py()) for v in t.column(f"c{x}")]))
    found = pa.Table.from_batches(near._classed(iter(t.slice(3).to_batches(max_chunksize=1500))))
    got = set(zip(found.column("a").to_pylist(), found.column("b").to_pylist()))
    every, s = list(zip(i.tolist(), j.tolist()))[3:], [set(x.tolist()) for x in sets]
    want = {(a, b) for a, b in every if 2 * len(s[a] & s[b]) >= len(s[a] | s[b])}
    assert len({len(v) for v in c.to_pylist()}) > 5 and any(len(c[a].as_py()) != len(c[b].as_py()) for a, b in want)
    assert len(want) > 200 and want <= got and len(got) < 0.5 * len(every)


def test_marks_keep_every_pair_over_the_threshold():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 1 << 48, 3000, dtype=np.uint64)
    sets = [rng.choice(pool[: 3000 if k % 3 else 400], int(rng.choice([2, 30, 250, 2400 if k % 3 else 380])), replace=False) for k in range(60)]
    sets += [np.append(x[: len(x) * 3 // 4], rng.integers(1, 1 << 48, len(x) // 5, dtype=np.uint64)) for x in sets]
    size = np.array([len(x) for x in sets])
    h, start = np.concatenate(sets), np.cumsum(size) - size
    mark = np.concatenate([(near._minima(h, start) & 255).astype(np.uint8), near._bits(h, start, size)], axis=1)
    t = pa.table({"tab": pa.array([0] * 120, pa.int32()), "rep": pa.array(range(120), pa.int64()), "n": pa.array(size, pa.int32()), "mark": pa.array([x.tobytes() for x in mark], pa.binary())})
    t = t.append_column("block", pa.array([0] * 120)).append_column("i", pa.array([0] * 120)).append_column("j", pa.array([0] * 120))
    t = t.append_column("key", pa.array([0] * 120))
    found = pa.Table.from_batches(near._within(iter(t.to_batches(max_chunksize=50))))
    got = set(zip(found.column("a").to_pylist(), found.column("b").to_pylist()))
    s = [set(x.tolist()) for x in sets]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 3 * len(s[a] & s[b]) >= len(s[a]) + len(s[b])}
    assert len(want) >= 50 and want <= got


def test_hot_repeated_row_is_packed_as_often_as_it_occurs(spark):
    rows = [(1, 100)] * 5000 + [(i, 700) for i in range(2, 3000)]
    p = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 1024, 16, 300).toPandas()
    assert len(p) == len(rows) and (p.doc_id == 1).sum() == 5000 and p.groupby("container").n_tokens.sum().max() <= 1024
    assert p.container.nunique() <= 1.03 * 2998
