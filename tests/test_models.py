import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from irspark.functions import html, siterules
from irspark.operators import chunking, models

PAGE = (
    "<title>T | S</title><nav>menu</nav><div id='q' class='ask'><h1>Why?</h1><p>Because I ask</div><div class='ans'><span class='who'>Dr A</span><p class='t'>First answer<div class='ad'>buy</div></div>"
    "<div class='ans'><p class='t'>Second answer</div><div class='post body'><p>Label:<p>value<p>one<p>one<p>Related<p>gone</div>"
)


def test_selectors():
    root = html.parse(PAGE)
    assert [n.text() for n in siterules.select(root, "div.ans p.t")][1] == "Second answer"
    assert len(list(siterules.select(root, "#q"))) == 1 and not list(siterules.select(root, "p.ans")) and len(list(siterules.select(root, "[class=who]"))) == 1


def test_rules():
    root = html.parse(PAGE)
    r = siterules.SiteRule("x", keep=("div.post",), cut_re="^Related$", join_labels=True, dedupe_lines=True, min_chars=3)
    assert siterules.site_lines(root, r) == ["Label: value", "one"]
    assert siterules.site_lines(root, siterules.SiteRule("x", keep=("div.none",))) is None and siterules.site_lines(root, siterules.SiteRule("x", keep=("div.post",), need="div.none")) is None
    qa = siterules.SiteRule("x", question=("div.ask",), answer="div.ans", drop=("div.ad", "span.who"), answer_author="span.who")
    lines, people = siterules.question_lines(root, qa)
    assert lines == ["# Why?", "Because I ask", "---", "First answer", "---", "Second answer"] and people[0] == {"author": "Dr A"}
    assert siterules.find_rule("a.x", [qa]) is qa and siterules.find_rule("ax", [qa]) is None
    blocks = html.parse("<div class=c><p id=b2>two<p id=b0>zero<p id=b1>one</div>")
    assert siterules.site_lines(blocks, siterules.SiteRule("x", keep=("div.c",), reorder=r"b(\d)", min_chars=1)) == ["zero", "one", "two"]


def test_fetch_retries_and_never_raises(spark):
    calls = {}

    def load():
        def get(url):
            if "boom" in url:
                raise OSError
            return ("http_503", None) if "busy" in url else ("ok", "<p>x")

        return get

    links = spark.createDataFrame([(1, "http://a/ok"), (2, "http://a/busy"), (3, "http://a/boom"), (4, None)], "id long, url string").where("url is not null")
    got = {r["id"]: (r["status"], r["attempts"]) for r in models.fetch(links, load, 2).collect()}
    assert got == {1: ("ok", 1), 2: ("http_503", 2), 3: ("err_oserror", 2)} and not calls


def test_extract_by_rule_and_generally(spark):
    raw = spark.createDataFrame([(1, "u", "a.x", PAGE), (2, "u", "b", "<p>" + "text " * 30), (3, "u", "b", None), (4, "u", "b", "<p>page not found")], "id long, url string, host string, html string")
    rule = siterules.SiteRule("x", keep=("div.post",), min_chars=3)
    got = {r["id"]: r for r in models.extract_pages(raw, 2, [rule], "page not found").collect()}
    assert got[1]["extractor"] == "rule" and got[1]["text"].startswith("Label:") and got[2]["status"] == "ok" and got[3]["status"] == "empty" and got[4]["status"] == "notice"


def test_encode_skips_what_is_done(spark):
    u = spark.createDataFrame([("1_p0", "h1", "c", "a b c"), ("2_p0", "h2", "", "d"), ("3_p0", "h3", "", None)], "unit_id string, h string, ctx string, text string")
    v = models.encode(u, u.where("unit_id = '1_p0'"), models.hashing_encoder(8)).collect()
    assert [r["unit_id"] for r in v] == ["2_p0"] and abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-5


def test_rerank_uses_the_unit_language(spark):
    run = spark.createDataFrame([(1, "1_p0", 1, 1), (1, "2_p0", 2, 2), (1, "3_p0", 3, 3), (1, "9_p0", 9, 4)], "qid long, unit_id string, doc_id long, rank long")
    units = spark.createDataFrame([("1_p0", "vi", "", "không"), ("2_p0", "en", "", "red cat"), ("3_p0", "vi", "", "mèo")], "unit_id string, lang string, ctx string, text string")
    q = spark.createDataFrame([(1, "vi", "mèo đỏ"), (1, "en", "red cat")], "qid long, lang string, query string")
    out = models.rerank(run, units, q, models.overlap_scorer, 3).orderBy("rank").toPandas()
    assert list(out.unit_id) == ["2_p0", "3_p0", "1_p0", "9_p0"]


def test_incremental_blocks(spark):
    a = spark.createDataFrame([("u1", "h1", 0), ("u2", "h2", 0), ("u3", "h3", 1)], "unit_id string, h string, block long")
    b = a.withColumn("h", F.when(F.col("unit_id") == "u3", "new").otherwise(F.col("h")))
    fp = lambda d: {r["block"]: r["fingerprint"] for r in chunking.block_fingerprints(d, F.col("block")).collect()}
    assert fp(a)[0] == fp(b)[0] and fp(a)[1] != fp(b)[1]
    assert [r["unit_id"] for r in chunking.pending(b, a).collect()] == ["u3"]
    assert sorted(r["unit_id"] for r in chunking.still_valid(a.union(a), b).collect()) == ["u1", "u2"]


def test_blind_comparison(spark):
    from irspark.operators import translate

    rows = [(i, "q" * (i + 1), f"a {i}", f"b {i} {'x' * i}") for i in range(30)] + [(99, "q", "same", "same"), (98, "q", None, "b")]
    x = translate.blind_pairs(spark.createDataFrame(rows, "qid long, query string, a string, b string"), 12, done=spark.createDataFrame([(3,)], "qid long"))
    key = x.toPandas()
    assert len(key) == 12 and not {3, 98, 99} & set(key.qid) and key.swapped.nunique() == 2
    votes = spark.createDataFrame([(int(q), "right" if s else "left", False, False) for q, s in zip(key.qid, key.swapped)], "qid long, better string, severe_left boolean, severe_right boolean")
    r = translate.blind_result(x, votes)
    assert r["a"] == 12 and r["b"] == 0 and r["p"] < 0.001 and translate.sign_test(0, 0) == 1.0


def test_header_dates_and_small_kernels(spark):
    import datetime

    from irspark.functions import dates, kernels
    from irspark.functions import text as T
    from irspark.operators.hosts import Limiter

    day = datetime.date(2026, 1, 1)
    assert dates.header_date(["# Title", "Ngày đăng: 27/08/2009"], day) == "2009-08-27" and dates.header_date(["Hà Vũ • 14/04/2025 - 19:25"], day) == "2025-04-14"
    assert dates.header_date(["In a long sentence that mentions the day 14/04/2025 somewhere in its text"], day) is None and dates.header_date(["x"] * 5 + ["2020-01-01"], day) is None
    assert dates.read_date("March 3, 2020", day) == "2020-03-03" and dates.read_date("31/02/2020", day) is None and dates.read_date("1700000000", day) == "2023-11-14"
    assert kernels.decoded_lines(["&amp;#8226; a", "***", "---", "b"]) == ["&#8226; a", "---", "b"]
    df = spark.createDataFrame([("notice", "t", "please solve the captcha"), ("notice", "t", "gone"), ("ok", "t", "captcha")], "s string, t string, x string")
    assert [r[0] for r in df.select(T.blocked_notice(F.col("s"), F.col("t"), F.col("x"), "(?i)captcha")).collect()] == ["blocked_notice", "notice", "ok"]
    now, slept = [0.0], []
    lim = Limiter(2, lambda: now[0], lambda s: slept.append(s) or now.__setitem__(0, now[0] + s))
    for _ in range(3):
        lim.wait()
    assert slept == [0.5, 0.5]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_unit_run_has_every_branch(spark):
    from irspark.plans import evaluation

    sf = "/root/testdata/sf0.001"
    branches = {r["branch"] for r in evaluation._runs(spark, sf).where("rank <= 20").select("branch").distinct().collect()}
    assert len(branches) > 2 and {r["branch"] for r in evaluation._unit_run(spark, sf).select("branch").distinct().collect()} == branches
    assert {r["branch"] for r in evaluation.score_units(spark, sf).select("branch").distinct().collect()} == branches


def test_fetch_under_host_control(spark):
    def load():
        left = {"a": 2}

        def get(url):
            host = url.split("/")[2]
            if host == "slow" and left["a"]:
                left["a"] -= 1
                return "http_429", None, 7
            if host == "gone":
                return "http_429", None, 500
            return "ok", "<p>x"

        return get

    now = [100.0]
    clock, sleep = lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)
    links = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(["slow", "slow", "gone", "gone", "gone"])], "id long, url string").coalesce(1)
    got = {r["id"]: (r["status"], r["attempts"]) for r in models.fetch(links, load, tries=3, rate=2.0, budget=60, clock=clock, sleep=sleep).collect()}
    assert got[0] == ("ok", 3) and got[1] == ("ok", 1)  # two answers named a wait, which was kept
    assert sorted(got[i][0] for i in (2, 3, 4)) == ["host_dead"] * 3


def test_dates_of_extracted_pages():
    from irspark.functions import html

    day = datetime.date(2026, 1, 1)
    page = lambda head, body: f"<html><head><title>T</title>{head}</head><body><article>{body}<p>{'text ' * 40}</article>"
    assert html.extract(page('<meta property="article:published_time" content="03/02/2021">', ""), as_of=day)["published"] == "2021-02-03"
    assert html.extract(page("", '<time datetime="2020-05-06T07:00">May</time>'), as_of=day)["published"] == "2020-05-06"
    assert html.extract(page("", "<p>Cập nhật: 07/08/2019</p>"), as_of=day)["published"] == "2019-08-07"
    assert html.extract(page('<meta property="article:published_time" content="03/02/2030">', ""), as_of=day)["published"] == ""


def test_repeated_region_is_left_out():
    from irspark.functions import html

    body = "one sentence of the text that stands here twice. " * 3
    root = html.parse(f"<div class=a><p>{body}<p>and more of it</div><div class=b><p>{body}</div><div class=b><p>something else</div>")
    lines = siterules.site_lines(root, siterules.SiteRule("x", keep=("div.a", "div.b")))
    assert lines == [body.strip(), "and more of it", "something else"]


def test_every_broken_invariant_is_told(spark):
    head = "doc_id long, unit_id string, parent_id string, char_start int, char_end int, text string"
    docs = [(1, "# one two three"), (2, "left out"), (3, None), (4, "- ---\n\u2003x\U0001d400y z")]
    good = [(1, "1_p0", None, 0, 13, "one two three"), (1, "1_p0_c0", "1_p0", 0, 7, "one two"), (1, "1_p0_c1", "1_p0", 8, 13, "three"), (2, "2_p0", None, 0, 8, "left out"), (4, "4_p0", None, 0, 3, "---"), (4, "4_p1", None, 5, 10, "x\U0001d400y z")]
    swap = lambda name, *new: [x for x in good if x[1] != name] + list(new)
    cases = [
        (good, []), (good + good, []),
        (swap("1_p0_c1", (1, "1_p0_c1", "1_p0", 6, 13, "o three")), [("units overlap", "1_p0_c1")]),
        (swap("4_p1", (4, "4_p1", None, 2, 10, "-\n\u2003x\U0001d400y z")), [("units overlap", "4_p1")]),
        (swap("1_p0_c1"), [("letters outside the units", "1_p0_c0")]), (swap("1_p0_c0"), [("letters outside the units", "1_p0_c1")]),
        (swap("4_p0"), [("letters outside the units", "4_p1")]), (swap("4_p1"), [("letters outside the units", "4_p0")]), (swap("2_p0"), [("letters outside the units", "2")]),
        (swap("2_p0", (2, "2_p0", None, 0, 8, "left-out")), [("text not at its place", "2_p0")]), (swap("2_p0", (2, "2_p0", None, 0, 8, None)), [("text not at its place", "2_p0")]),
        (good + [(9, "9_p0", None, 0, 1, "a")], [("text not at its place", "9_p0")]), (good + [(2, "2_p0_c0", "2_p9", 0, 8, "left out")], [("child outside its parent", "2_p0_c0")]),
    ]
    at = lambda k, s: s and str(int(s[0]) + 10 * k) + s[1:]  # noqa: E731  # each case has documents of its own
    d = spark.createDataFrame([(i + 10 * k, t) for k in range(len(cases)) for i, t in docs], "doc_id long, text string")
    u = spark.createDataFrame([(i + 10 * k, at(k, a), at(k, b), *rest) for k, (units, _) in enumerate(cases) for i, a, b, *rest in units], head)
    want = sorted((p, at(k, x)) for k, (_, told) in enumerate(cases) for p, x in told)
    assert sorted(tuple(r) for r in chunking.invariant_violations(u, d).collect()) == want


def test_texts_of_documents_are_not_broadcast(spark, monkeypatch):
    plans = []
    inner = chunking.written

    def written(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df, *more)

    monkeypatch.setattr(chunking, "written", written)
    d = spark.createDataFrame([(1, "vi", "qa", "t", "one two")], "doc_id long, lang string, doc_type string, title string, text string")
    out = chunking.invariant_violations(inner(chunking.units(d), "units"), inner(d, "documents"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 0 and not any("BroadcastExchange" in x for x in plans)
