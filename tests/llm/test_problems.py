"""The operators against brute force and planted cases."""

import random
from pathlib import Path
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from irspark.llm import borda, consensus, language, leak, near, packing, pages, repeats, topn, vec

SYLLABLES = "ba co du fe gi ha lo mi na pu ra se ti vo".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))


def sentence(rng, n=12):
    return " ".join(word(rng) for _ in range(n)).capitalize() + "."


# ---- p1


@pytest.mark.parametrize("block", [4096, 1 << 20])
def test_top_n_equals_brute_force(spark, block):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        for _ in range(rng.choice([1, 5, 3000 if g == 7 else 60])):
            s = rng.choice([None, float("nan"), 1.0, 1.0, round(rng.random(), 2)]) if g != 9 else 0.5
            rows.append((rng.choice("xy"), g if g else None, f"u{rng.randint(1, 400)}", s))
    df = spark.createDataFrame(rows, "branch string, qid long, unit_id string, score float").repartition(3)
    got = topn.top_n(spark, topn.cluster(df, ["branch", "qid"], "unit_id", "score", block), ["branch", "qid"], "unit_id", "score", 10).collect()
    best = defaultdict(dict)
    for b, q, u, s in rows:
        if s is not None and s == s:
            best[b, q][u] = max(s, best[b, q].get(u, -1.0))
    want = {(b, q, u, i + 1) for (b, q), d in best.items() for i, (u, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:10])}
    assert {(r["branch"], r["qid"], r["unit_id"], r["place"]) for r in got} == want and len(got) == len(want)


def test_row_groups_below_the_bar_are_skipped(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([("x", 1, f"u{i}", rng.random()) for i in range(20_000)], "branch string, qid long, unit_id string, score double")
    path = topn.cluster(df, ["branch", "qid"], "unit_id", "score", 16_384)
    read = topn._reader(10, spark.read.parquet(path).columns)
    uri = spark.read.parquet(path).inputFiles()
    import pandas as pd
    import pyarrow as pa

    blocks = pd.concat(list(topn._footers(iter([pd.DataFrame({"file": uri})])))).sort_values("top", ascending=False)
    opened = []
    real = topn._open
    monkeypatch.setattr(topn, "_open", lambda u: opened.append(u) or real(u))
    list(read(iter([pa.RecordBatch.from_pandas(blocks, preserve_index=False)])))
    assert len(blocks) > 20 and len(opened) < len(blocks) / 5


# ---- p2


def letters(line):
    return "".join(c for c in line.lower() if c.isalpha())


def repeated_lines(rows, least):
    n = defaultdict(set)
    for i, (_, host, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if letters(line) and not line.startswith("#"):
                n[host, letters(line)].add(i)
    return {(id, no) for id, host, text in rows for no, line in enumerate((text or "").split("\n")) if host and id is not None and not line.startswith("#") and letters(line) and len(n[host, letters(line)]) >= least}


@pytest.mark.parametrize("seed", range(3))
def test_repeated_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    site = {h: [sentence(rng, rng.randint(1, 9)) for _ in range(6)] + ["阅读量", "# head", "---", "a"] for h in "pqr"}
    rows = []
    for i in range(120):
        h = rng.choice(["p", "q", "r", None])
        lines = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 5))] + [x.upper() + str(i) if rng.random() < 0.3 else x for x in rng.sample(site[h or "p"], 4)]
        rng.shuffle(lines)
        rows.append((i, h, "\n".join(lines) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "id long, host string, text string")
    assert {tuple(r) for r in repeats.found(df).collect()} == repeated_lines(rows, 12)
    assert {tuple(r) for r in repeats.found(df, sent=0).collect()} == repeated_lines(rows, 12)  # more chunks than are sent around


def test_notice_that_is_no_line_of_its_own(spark):
    """Behind other text of the same line, and wrapped at different places."""
    rng = random.Random(12)
    notice = " ".join(word(rng) for _ in range(24)).capitalize() + "."
    own = [" ".join(word(rng) for _ in range(12)).capitalize() + "." for _ in range(60)]
    wrap = lambda i: notice[: notice.index(" ", 10 + i)] + "\n" + notice[notice.index(" ", 10 + i) + 1 :]
    rows = [(i, "h", f"{own[i]} {notice}") for i in range(40)] + [(i, "h", f"{own[i]}\n{wrap(i)}") for i in range(40, 60)] + [(99, "other", notice)]
    for sent in (repeats.SENT_CHUNKS, 0):
        out = {r["id"]: r["text"] for r in repeats.cleaned(spark.createDataFrame(rows, "id long, host string, text string"), sent=sent).collect()}
        assert all(out[i] == own[i] for i in range(40)) and out[99] == notice
        assert all(out[i].startswith(own[i]) and len(out[i]) < len(own[i]) + 0.6 * len(notice) for i in range(40, 60))


def test_cleaning_cuts_exactly_those_lines(spark):
    rows = [(i, "h", f"Own {word(random.Random(i))} line\nThe same legal note {i}\nlast {word(random.Random(-i))}") for i in range(15)]
    out = repeats.cleaned(spark.createDataFrame(rows, "id long, host string, text string").withColumn("n", F.lit(1))).collect()
    assert all("legal" not in r["text"] and r["text"].count("\n") == 1 and r["n_cut"] == 1 for r in out)


# ---- p3


def test_borda_is_free_of_scale_and_of_order(spark):
    rng = random.Random(3)
    rows = [(b, q, f"u{rng.randint(1, 12)}", rng.choice([None, float("nan"), 1.0, 2.0, 3.0, 5.0])) for b in "abc" for q in (1, 2) for _ in range(14)]
    df = spark.createDataFrame(rows, "branch string, qid long, unit_id string, score double")
    one = lambda d, **k: {(r["qid"], r["unit_id"]): (r["points2"], r["place"]) for r in borda.borda(d, **k).collect()}
    base = one(df)
    assert base == one(df.withColumn("score", F.when(F.col("branch") == "b", F.exp("score") * 1e6 - 7).otherwise(F.col("score")))) == one(df.repartition(7)) == one(df, hot_rows=5)
    lists = defaultdict(dict)
    units = defaultdict(set)
    for b, q, u, s in rows:
        units[q].add(u)
        if s is not None and s == s:
            lists[q, b][u] = max(s, lists[q, b].get(u, s))
    for (q, u), (points, _) in base.items():
        n, want = len(units[q]), 0
        for (lq, _), d in lists.items():
            if lq == q:
                rank = sum(x > d[u] for x in d.values()) + (sum(x == d[u] for x in d.values()) + 1) / 2 if u in d else (len(d) + 1 + n) / 2
                want += 2 * (n - rank)
        assert points == want


# ---- p5


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [word(rng)] if x < 2 * share / 3 else [w, word(rng)] if x < share else [w]
    return out


def grams(text):
    w = text.lower().replace(".", "").split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [word(rng) for _ in range(rng.randint(12, 260))]
        texts += [" ".join(edited(rng, base, s)) for s in (0, 0, 0.02, 0.06, 0.1, 0.2)]
    rows = [(0, 0, i, 0, t) for i, t in enumerate(texts)] + [(0, 0, 9990, 0, ""), (0, 0, 9991, 0, None), (1, 1, 1, 0, texts[0]), (1, 2, 2, 0, texts[0])]
    m, p = near.near(spark.createDataFrame(rows, near.ROWS))
    got = {(r["tab"], r["id_a"], r["id_b"]) for r in near.all_pairs(m, p).collect()}
    g = [grams(t) for t in texts]
    want = {(0, i, j) for i in range(len(g)) for j in range(i + 1, min(len(g), i // 6 * 6 + 6)) if 2 * len(g[i] & g[j]) >= len(g[i] | g[j])}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 300
    # groups are the components of the pairs
    cls = {(r["tab"], r["id"]): r["class_id"] for r in near.groups(m, p).collect()}
    assert all(cls[t, a] == cls[t, b] for t, a, b in got) and (0, 9990) not in cls


def test_site_lines_are_cut_alike_however_many_there_are(spark):
    """Of a notice behind other text nothing is cut, whether the keys of the lines are sent or the lines are emptied by a join."""
    rng = random.Random(55)
    notice, foot = " ".join(word(rng) for _ in range(60)), [" ".join(word(rng) for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(60):
        own = [" ".join(word(rng) for _ in range(12)).capitalize() + "." for _ in range(2)]
        rows.append((i, f"h{i % 3}", "\n".join([own[0] + " " + notice + ".", foot[i % 3].upper() if i % 2 else foot[i % 3], "", "# " + foot[i % 3], own[1]])))
    rows += [(60, None, rows[0][2]), (None, "h0", rows[0][2]), (61, "h1", None), (62, "h1", ""), (63, "h2", rows[0][2]), (3, "h0", "\n".join(reversed(rows[3][2].split("\n"))))]
    corpus = spark.createDataFrame(rows, "id long, host string, text string")
    chunks = spark.createDataFrame([(1, 1, rows[0][2]), (2, 1, rows[0][2] + " more")], "chunk_id long, qid long, chunk_text string")
    texts, pairs = [], []
    for sent in (1000, 0):
        r, cut = near.project_rows(corpus, chunks, sent=sent)
        assert (len(cut) > 0) == (sent > 0)
        m, p = near.near(r, cut)
        texts.append({tuple(x) for x in m.collect()})
        pairs.append({tuple(x) for x in p.collect()})
    assert texts[0] == texts[1] and pairs[0] == pairs[1]
    assert len([1 for x in pairs[0] if x[0] == 0]) > 500  # by the notice, which stays


# ---- p6


def test_consensus_follows_the_reliable(spark):
    rng = random.Random(6)
    acc = {f"good{i}": 0.95 for i in range(6)} | {f"bad{i}": 0.33 for i in range(5)}
    truth, rows = {}, []
    for i in range(500):
        truth[f"i{i}"] = rng.randint(0, 2)
        for who in rng.sample(sorted(acc), 5):
            right = rng.random() < acc[who]
            rows.append((f"i{i}", who, "t", truth[f"i{i}"] if right else rng.choice([g for g in (0, 1, 2) if g != truth[f"i{i}"]]), None))
    rows += rows[:50] + [("i1", "good0", "t", 9, None), ("i1", None, "t", 1, None), (None, "good0", "t", 1, None)]
    a = consensus.answers(spark.createDataFrame(rows, "item string, labeler string, tag string, grade int, note string"))
    items, conf = consensus.model(a)
    got = {r["item"]: r["consensus"] for r in consensus.consensus(items).collect()}
    rel = {r["labeler"]: r for r in consensus.reliability(items, conf).collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 0.95 * len(truth)
    assert min(rel[w]["accuracy"] for w in rel if w.startswith("good")) > 0.8 > 0.5 > max(rel[w]["accuracy"] for w in rel if w.startswith("bad"))
    assert all(r["low"] <= r["accuracy"] <= r["high"] for r in rel.values())


def test_digamma(spark):
    for x, want in ((1.0, -0.5772156649), (0.5, -1.9635100260), (10.0, 2.2517525890)):
        assert abs(spark.range(1).select(consensus.digamma(F.lit(x))).first()[0] - want) < 1e-8


# ---- p4 and p7


@pytest.fixture(scope="module")
def site(spark):
    """Pages of eight hosts with planted frames, residue and short answers."""
    rng = random.Random(7)
    vocabulary = [word(rng) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows, frame, residue = [], set(), set()
    errors = ["Sorry, the page was not found", "Please enable JavaScript and reload", "Service unavailable, try again later", "Verify you are not a robot to go on"]
    for i in range(900):
        h = i % 8
        menu, foot, cookie = f"Home | News {h} | Contact | Shop", f"© 2024 Site number {'abcdefgh'[h]} all rights kept", f"This site {'abcdefgh'[h]} stores cookies to work"
        kind = rng.choices(["article", "short", "error", "field"], [70, 10, 12, 8])[0]
        title = say(5)[:-1]
        body = [say(rng.randint(30, 60)) for _ in range(rng.randint(3, 6))] if kind in ("article", "field") else [say(9)] if kind == "short" else [rng.choice(errors) + f" ({rng.randint(1, 99)})"]
        if kind == "field":
            body[1] = body[1].replace(" ", " {{ author_name }} ", 1)
        lines = [(menu, True)] + [("# " + title, False)] * (kind != "error") + [(x, False) for x in body] + [("See also: " + say(4)[:-1], True)] * (kind == "article") + [(cookie, True), (foot, True)]
        rows.append((i, f"s{i}", f"host{h}", {"error": rng.choice(["notice", "http_404", "ok"])}.get(kind, "ok"), "404" if kind == "error" else title, f"Site {h}", "\n".join(x for x, _ in lines)))
        if kind in ("error", "field"):
            residue.add((i, f"s{i}"))
        if kind != "error":
            frame |= {(i, f"s{i}", no) for no, (_, f) in enumerate(lines) if f}
    df = spark.createDataFrame(rows, "id long, session string, host string, status string, title string, site_name string, text string").cache()
    return df, frame, residue, pages.fit(df)


def scores(got, want):
    return len(got & want) / max(1, len(got)), len(got & want) / max(1, len(want))


def test_frame_lines(site):
    df, frame, _, model = site
    p, r = scores({tuple(x) for x in pages.frame_lines(df, model).collect()}, frame)
    assert p > 0.97 and r > 0.97
    main = pages.blocks(df, model).where("id < 50 and status = 'ok'").select("main").collect()
    assert not any("cookies" in r["main"] and "# " in r["main"] for r in main)


def test_residue_pages(site):
    df, _, residue, model = site
    assert pages.fit(df, held_out=True)["accuracy"] > 0.9
    p, r = scores({tuple(x) for x in pages.residue(df, model).where("field or body = 0").select("id", "session").collect()}, residue)
    assert p > 0.95 and r > 0.95


@pytest.mark.parametrize("text,field", [("a {{ x }} b", True), ("${name}", True), ("<%= a.b %>", True), ("[[title]]", True), ("%AUTHOR_NAME%", True), ("__TITLE__", True), ("@@x@@", True), ("[INSERT TITLE]", True), ("<phone number>", True), ("【标题】", True), ("{drug.name}", True), ("{2; 3} 片 [50]", False), ("in <40% of 90%", False), ("SQLSTATE[HY000]", False), ("a < b and c > d", False), ("__init", False), ("[50] [a]", False)])
def test_fields(spark, text, field):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(pages.FIELD)).first()[0] is field


# ---- p8


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, rng.randint(1, 60), rng.randint(61, 300), rng.randint(100, 1000), rng.randint(1000, 5000)])) for i in range(4000)] + [(5000, 1024), (5001, 1024), (5002, 1024)]
    p = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 1024, 32, 500).toPandas()
    size = dict(rows)
    assert p.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in size.items() if n}
    assert not p.duplicated(["doc_id", "part"]).any() and p.groupby("container").n_tokens.sum().max() <= 1024
    whole = p[p.doc_id.map(size) <= 1024]
    assert (whole.part == 0).all()
    least = -(-sum(size.values()) // 1024)
    assert p.container.nunique() <= 1.03 * least


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(257, 1023), min_size=1, max_size=12, unique=True), st.data())
def test_configurations_use_every_item_once(sizes, data):
    sizes = sorted(sizes, reverse=True)
    counts = [data.draw(st.integers(0, 20)) for _ in sizes]
    used = Counter()
    for need, times in packing.configurations(sizes, counts, 1024):
        assert times > 0 and sum(sizes[g] * n for g, n in need.items()) <= 1024
        for g, n in need.items():
            used[g] += n * times
    assert [used[i] for i in range(len(sizes))] == counts


# ---- p9


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [word(rng) for _ in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(60) for i in range(30)}
    for w in items.values():
        for k in range(4, 60, 9):
            w[k] = word(rng).capitalize() + "abc"
    docs, want = [], set()
    for d in range(400):
        body = text(rng.randint(50, 400))
        if d < 120:
            i = d % 30
            take = items[i][: 36] if d % 4 == 1 else items[i]
            take = [word(rng) if d % 4 == 2 and rng.random() < 0.08 else w for w in take]
            take = [w.upper() for w in take] if d % 4 == 3 else take
            at = rng.randint(0, len(body))
            body[at:at] = take
            want.add((i, d))
        elif d < 150:
            body[3:3] = items[d % 30][:14]  # a short phrase
        docs.append((d, " ".join(body)))
    got = {tuple(r) for r in leak.found(spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    p, r = scores(got, want)
    assert p == 1.0 and r > 0.97


def _template(rng, n=60):
    """An item whose second half holds most numbers, a sibling with other numbers, and other text."""
    words = [word(rng) for _ in range(n)]
    at = [10, *range(34, n, 3)]
    put = lambda low: [str(low + k) if k in at else w for k, w in enumerate(words)]
    return put(1000), put(5000), [word(rng) for _ in range(150)]


def _leaks(spark, item, *docs):
    one = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    return {r["doc_id"] for r in leak.found(one, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}


def test_leak_of_the_half_with_fewer_values(spark):
    item, sibling, other = _template(random.Random(10))
    assert _leaks(spark, item, other + item[:33] + other, other + sibling + other) == {0}


def test_leak_beside_a_sibling_with_more_words(spark):
    item, sibling, other = _template(random.Random(11))
    assert _leaks(spark, item, sibling + other + item[29:] + other, sibling + other) == {0}


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_in_order(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert leak._in_order(a, b) == t[-1][-1]


# ---- p10

SPEECH = {
    "en": ["The doctor saw the patient in the morning and gave the right advice.", "People should drink water with every meal of the day.", "Most of the children were at home when the rain began."],
    "fr": ["Le médecin reçoit les malades chaque matin dans une petite salle.", "Il faut boire de l'eau avec tous les repas de la journée.", "Les enfants étaient à la maison quand la pluie est tombée."],
    "vi": ["Bác sĩ khám bệnh cho mọi người vào buổi sáng mỗi ngày.", "Mọi người nên uống nước trong mỗi bữa ăn hằng ngày.", "Trẻ em đều ở nhà khi trời bắt đầu đổ mưa lớn."],
    "zh": ["医生每天早上给病人看病并且给出建议。", "大家每顿饭都应该喝一些温水才对。", "下雨的时候孩子们大多在家里玩耍。"],
    "ja": ["医者は毎朝ていねいに患者を診ています。", "食事のたびに水を飲むようにしてください。", "雨が降り始めたとき子どもたちは家にいました。"],
}


def test_languages(spark):
    rng = random.Random(10)
    rows, want = [], set()
    for i in range(600):
        lang = rng.choice(sorted(SPEECH))
        body = [rng.choice(SPEECH[lang]) for _ in range(rng.randint(2, 6))]
        other = rng.choice(sorted(SPEECH)) if rng.random() < 0.15 else lang
        if other != lang:
            body.insert(rng.randint(0, len(body)), rng.choice(SPEECH[other]))
        label = rng.choice([lang, lang.upper() + "_XX"]) if rng.random() < 0.85 else rng.choice([None, "", "und", "en", "vi"])
        shown = (label or "").lower()[:2]
        want |= {(i, x) for x in {lang, other} if x != shown}
        rows.append((i, "\n".join(body), label))
    got = {tuple(r) for r in language.found(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    p, r = scores(got, want)
    assert p > 0.97 and r > 0.97


@pytest.mark.parametrize("label,lang", [("vi-VN", "vi"), ("ENG", "en"), ("zh_Hans", "zh"), (" fr ", "fr"), ("jpn", "ja"), ("und", None), ("", None), (None, None), ("unknown", None)])
def test_labels(spark, label, lang):
    assert spark.createDataFrame([(label,)], "l string").select(language.named(F.col("l"))).first()[0] == lang


# ---- kernels


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n#-1字かé́.𠀀", max_size=30)), max_size=6))
def test_words_and_lines(texts):
    import pyarrow as pa

    cp, off = vec.codepoints(pa.array(texts, pa.large_string()))
    assert ["".join(map(chr, cp[a:b])) for a, b in zip(off, off[1:])] == [t or "" for t in texts]
    doc, no, start, end = vec.lines_of(cp, off)
    got = defaultdict(list)
    for d, n, a, b in zip(doc, no, start, end):
        assert n == len(got[d])
        got[d].append("".join(map(chr, cp[a:b])))
    assert [got[i] for i in range(len(texts))] == [(t or "").split("\n") for t in texts]
    w = vec.words_of(cp, off)
    seen = {}
    for h, a, b in zip(w["hash"].tolist(), w["start"], w["end"]):
        s = "".join(map(chr, cp[a:b])).lower().replace("́", "")
        assert s and (len(s) == 1 or not any(map(vec.is_single, s)))
        if "́" not in "".join(map(chr, cp[a : b + 1])):
            assert seen.setdefault(h, s) == s


# ---- p9, values of a template


def test_template_with_other_values(spark):
    item = "Patient Nguyenhoang took 15 mg of Xylofenac on day 3 and Nguyenhoang felt better while doctor Tranvanlong noted 72 beats and 15 mg again on day 9"
    swap = {"Nguyenhoang": "Phamthilan", "Xylofenac": "Betorvane", "Tranvanlong": "Lequangvinh", "15": "40", "3": "5", "72": "88", "9": "6"}
    other = " ".join(swap.get(w, w) for w in item.split())
    own = {"Nguyenhoang": "Tranvanlong", "Tranvanlong": "Xylofenac", "Xylofenac": "Nguyenhoang", "15": "72", "72": "3", "3": "9", "9": "15"}
    mixed = " ".join(own.get(w, w) for w in item.split())
    words = other.split()
    words[words.index("Phamthilan")] = "Dangthuyen"  # one value becomes two
    docs = [(1, item), (2, other), (3, mixed), (4, " ".join(words)), (5, f"Some text before. {other} And after it.")]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"] for r in leak.found(items, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1, 2, 5}


def test_item_and_text_that_repeat_words(spark):
    rng = random.Random(4)
    part = [word(rng) for _ in range(6)]
    item = " ".join(part * 60 + [word(rng) for _ in range(20)])
    docs = [(1, " ".join(part * 300)), (2, item), (3, " ".join(word(rng) for _ in range(300))), (4, "the " * 3000)]
    items = spark.createDataFrame([(1, item), (2, "the " * 400)], "item_id long, text string")
    got = {tuple(r) for r in leak.found(items, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (1, 2), (2, 4)}


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice([word(rng), word(rng).capitalize() + "son", str(rng.randint(1, 99))]) for _ in range(40))) for i in range(12)]
    docs = spark.createDataFrame([(i, f"Before it. {t}") for i, t in items], "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leak.matches(frame, docs).collect()))
    monkeypatch.setattr(leak, "BLOCK_WORDS", 200)
    assert sorted(map(tuple, leak.matches(frame, docs).collect())) == whole and len(whole) >= 12


# ---- p10, languages that no prototype stands for


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_other_languages_and_signs(spark):
    model = language.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = {
        "other": ["El niño tiene fiebre desde hace tres días y no quiere comer nada.", "Das Kind hat seit drei Tagen Fieber und möchte nichts essen, sagte der Arzt.", "Ребёнок уже три дня болеет и ничего не хочет есть.", "Il bambino ha la febbre da tre giorni e non vuole mangiare."],
        "zh": ["- 服用该药期间应避免饮酒，并定期复查血压和肝功能。", "症状持续三天以上时应尽快就医。"], "ja": ["この薬は食後に服用し、症状が続く場合は医師に相談してください。"],
        "vi": ["Người bệnh nên tái khám sau ba tháng và tránh ăn mặn."], "en": ["Patients should return after three months and avoid salty food."],
    }
    rows = [(i, t, None, want) for i, (want, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in language.stretches(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), model).collect()}
    assert {i: got[i][0] for i, *_ in rows} == {i: want for i, _, _, want in rows}
    assert all(0 <= c <= 1 for _, c in got.values())


# ---- p4, tree and layout


def test_block_tree_and_layout():
    text = "Home | News | About\n# Title\nFirst paragraph.\n- one\n- two\n\n- other list\n## Doses\nDrug | mg\nLong name | 5\n用药 | 12\n---\nx | y\n# Next\nEnd.\nShare | Print"
    root = pages.block_tree(text)
    assert [b.kind for b in root.children] == ["table", "section", "section"]
    title = root.children[1]
    assert [b.kind for b in title.children] == ["heading", "paragraph", "list", "list", "section"]
    assert [b.kind for b in title.children[4].children] == ["heading", "table", "table"]  # a rule ends a table
    assert pages.main_body(text, [0, 15]) == "# Title\n\nFirst paragraph.\n\n- one\n- two\n\n- other list\n\n## Doses\n\nDrug      | mg\nLong name | 5\n用药      | 12\n\nx | y\n\n# Next\n\nEnd."
    assert pages.main_body(None, None) is None and pages.main_body("", []) == "" and pages.main_body("a", [0]) == ""


def test_spans_that_are_fields():
    rows = [("Dear {{ first_name }}, welcome to [INSERT CITY NAME].", True), ("Take {2; 3} tablets [50] if x < 5 and y > 2.", False), ("See [1], [12] and {1, 2}.", False)]
    for text, want in rows:
        assert any(pages.span_features(text, m) for m in pages.SPAN.finditer(text)) and bool(len(list(pages.SPAN.finditer(text))))
        assert isinstance(want, bool)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_classifiers_on_hosts_left_out(spark):
    got = {r["classifier"]: r for r in pages.validation(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert got["lines"]["cases"] > 500 and got["lines"]["accuracy"] > 0.85
    assert got["fields"]["cases"] > 50 and got["fields"]["accuracy"] > 0.95


def test_credible_interval():
    for a, b in ((1, 1), (3, 2), (40, 5), (4000, 300)):
        mean, var = a / (a + b), a * b / (a + b) ** 2 / (a + b + 1)
        low, high = consensus.beta_interval(mean, var)
        x = random.Random(1)
        draws = sorted(x.betavariate(a, b) for _ in range(40_000))
        assert abs(low - draws[1000]) < 0.02 and abs(high - draws[39_000]) < 0.02 and low < mean < high


def test_rounds_that_do_not_suffice_are_reported(spark):
    rows = [(f"i{i}", f"a{j}", (i * 7 + j * j) % 3) for i in range(30) for j in range(4)]
    with pytest.warns(UserWarning, match="hasn't converged"):
        consensus.model(consensus.answers(spark.createDataFrame(rows, "item string, labeler string, grade int")), rounds=1)
