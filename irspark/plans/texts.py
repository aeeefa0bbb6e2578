"""Queries over single texts: scalar functions, kernels, HTML, translation checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, kernels
from ..functions import text as T
from ..functions.dates import norm_date
from ..operators import translate
from ..sources import tables as src

# Phrases of notices in the project's languages, for short pages only.
NOTICE = (
    r"(?i)không tìm thấy|không tồn tại|chưa có nội dung|vui lòng bật javascript|đang chuyển hướng|page not found|does not exist|access denied|enable javascript|not available"
    r"|verify you are (?:a )?human|has been (?:removed|deleted)|页面不存在|找不到|已被删除|请启用|安全验证|人机验证"
)
_RULES = [("example", None, "knowledge"), ("test", r"^/qa/", "qa"), ("test", None, "knowledge"), ("invalid", r"^/news/", "news")]
_RATES = [("suckhoe-fabilogadu.test", None, "slow"), ("test", None, "test-zone")]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_text(spark, sf):
    return _t(spark, sf, "corpus").select("id", T.to_plain(F.col("text")).alias("plain"))


def text_hashes(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


def line_markers(spark, sf):
    x = _t(spark, sf, "corpus").select("id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return x.select("id", F.col("no").cast("long").alias("no"), T.marker(F.col("line")).alias("marker"), T.content(F.col("line")).alias("content"))


def detect_lang(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.detect_lang(F.col("text"), F.col("source"), F.col("lang")).alias("detected"))


def notices(spark, sf):
    return _t(spark, sf, "pages").where("text is not null").select("id", "session", T.is_notice(F.col("title"), F.col("text"), NOTICE).alias("notice"))


def outcomes(spark, sf):
    s = F.col("status")
    return _t(spark, sf, "pages").where("status is not null").groupBy("status", T.outcome(s).alias("outcome"), T.status_rank(s).cast("long").alias("rank"), T.host_kind(s).alias("kind"), T.done(s).alias("done"), T.counts_as_attempt(s).alias("attempt")).count().withColumnRenamed("count", "n")


def host_suffix_filter(spark, sf):
    h = T.host_of(F.col("url"))
    return _t(spark, sf, "pages").withColumn("h", h).where(T.host_matches(F.col("h"), ["suckhoe-fabilogadu.test", "example"])).select("id", "session", "h")


def host_rules(spark, sf):
    """Type and rate group of every link by rule tables."""
    h, p = T.host_of(F.col("url")), F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("/"))
    return _t(spark, sf, "pages").select("url").distinct().select("url", T.first_rule(h, p, _RULES, "other").alias("doc_type"), T.first_rule(h, p, _RATES, h).alias("rate_group"))


def shard_filter(spark, sf):
    return _t(spark, sf, "pages").where(T.in_shard(F.col("id"), 1, 4)).select("id", "session")


def link_numbers(spark, sf):
    """The number in a bibliographic link, for links rebuilt to hold their id."""
    url = F.concat(F.lit("https://pubmed.example/"), F.col("id").cast("string"), F.lit("/"))
    return _t(spark, sf, "corpus").select("id", T.number_after(url, "pubmed.example").alias("number"))


def keywords(spark, sf):
    return _t(spark, sf, "pages").where("keywords <> ''").select("keywords").distinct().select("keywords", F.array_join(T.split_keywords(F.col("keywords")), "|").alias("parts"))


def tidy_paths(spark, sf):
    parts = F.split(F.concat_ws(" > ", F.lit("Trang chủ"), "section", "title"), " > ")
    return _t(spark, sf, "corpus").select("id", T.tidy_path(parts, F.col("title")).alias("path"))


def contexts(spark, sf):
    heads = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6} (.*)$"), F.lit(1)), lambda x: F.trim(x))
    return _t(spark, sf, "corpus").select("id", T.context(F.col("title"), F.slice(heads, 1, 3)).alias("ctx"))


def unit_inputs(spark, sf):
    return _t(spark, sf, "qrels").where("text is not null").select("qid", "unit_id", F.md5(T.unit_input(F.col("lang"), F.col("text"))).alias("input")).distinct()


def blind_codes(spark, sf):
    return _t(spark, sf, "judge_key").select("qid", "unit_id", T.code(F.col("qid"), F.col("unit_id"), "13").alias("code"))


def unit_algebra(spark, sf):
    from ..operators.runs import doc_of, parent_of

    x = _t(spark, sf, "qrels").select(F.concat("unit_id", F.lit("_c2")).alias("unit_id")).distinct()
    return x.select("unit_id", parent_of().alias("parent"), doc_of().alias("doc"))


def norm_dates(spark, sf):
    """Order dates in seven notations; all must come back."""
    d = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    forms = [F.date_format("d", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy年M月d日", "MMMM d, yyyy", "d MMM yyyy")] + [F.concat(F.lit("ngày "), F.dayofmonth("d"), F.lit(" tháng "), F.month("d"), F.lit(" năm "), F.year("d")), F.unix_timestamp(F.col("d").cast("timestamp")).cast("string")]
    x = d.select("o_orderkey", F.posexplode(F.array(*forms)).alias("form", "raw"))
    return x.select("o_orderkey", F.col("form").cast("long").alias("form"), norm_date(F.col("raw"), F.lit("2030-01-01").cast("date")).alias("iso"))


def _pairs(spark, sf):
    """Translations as the project has them: the Vietnamese query with its English and Chinese versions."""
    q = src.query_texts(_t(spark, sf, "queries"))
    by = lambda lang, name: q.where(F.col("lang") == lang).select("qid", F.col("query").alias(name))
    return by("vi", "query").join(by("en", "en"), "qid", "left").join(by("zh", "zh"), "qid", "left")


def translation_checks(spark, sf):
    return translate.checks(_pairs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("en_ratio", "zh_ratio")})


def translation_summary(spark, sf):
    return translate.summary(translate.checks(_pairs(spark, sf)))


def translation_questions(spark, sf):
    return translate.questions_and_acronyms(_pairs(spark, sf))


def query_fallback(spark, sf):
    return src.with_fallback(src.query_texts(_t(spark, sf, "queries")), "zh")


_GLOSSARY = ["# alias\ten\tzh\tnote", "viêm phế quản|VPQ\tbronchitis\t支气管炎\t", "viêm\tinflammation\t炎\t", "hạt óc chó\twalnut\t核桃\tfood", "loãng xương\tosteoporosis\t骨质疏松\t", "=VI\tVI\tVI\t"]


def glossary_hits(spark, sf):
    g = translate.glossary(spark.createDataFrame([(x,) for x in _GLOSSARY], "value string"))
    h = translate.hits(src.query_texts(_t(spark, sf, "queries")).where("lang = 'vi'"), g)
    return h.join(g.select("no", "en").distinct(), "no").select("qid", "pos", "en")


def copied_translations(spark, sf):
    p = _pairs(spark, sf)
    return translate.copies(p, [("Viêm khớp Risokusase nên kiêng hạt óc chó bao lâu?", "How long should walnuts be avoided with Risokusase arthritis?")])


def _as_html(b: pd.DataFrame) -> pd.Series:
    def build(title, text, site, published, author):
        body = []
        for line in (text or "").split("\n"):
            mark, c = kernels.split_marker(line)
            tag = f"h{len(mark) - 1}" if mark.startswith("#") else "li" if mark else "p"
            body.append(f"<{tag}>" + c.replace("&", "&amp;").replace("<", "&lt;") + ("" if tag in ("p", "li") else f"</{tag}>"))
        ld = '<script type="application/ld+json">{"@type":"Article","datePublished":"%s","author":{"name":"%s"},}</script>' % (published or "", (author or "").replace('"', ""))
        return f"<html><head><title>{title or ''} | {site or ''}</title><meta property=og:site_name content=\"{site or ''}\">{ld}</head><body><nav><a href=/>Home</a></nav><article>{''.join(body)}<script>x()</script></article><footer>©</footer>"

    return pd.Series([build(*x) for x in zip(b["title"], b["text"], b["site_name"], b["published"], b["author"])])


def page_extract(spark, sf):
    """Pages built from the corpus' texts and extracted again."""
    cols = ["title", "text", "description", "author", "published", "modified", "keywords", "site_name", "section", "status"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [html.extract(h, None, host) for h, host in zip(_as_html(b), b["host"])]
            yield pd.DataFrame(rows, columns=cols).assign(id=b["id"].to_numpy())[["id", *cols]].fillna("").astype({c: str for c in cols})

    return _t(spark, sf, "corpus").select("id", "host", "title", "text", "site_name", "published", "author").mapInPandas(run, "id long, " + ", ".join(f"{c} string" for c in cols))


def kernel_lines(spark, sf):
    """Composed, cleaned lines of all texts."""

    @F.pandas_udf("string")
    def clean(t: pd.Series) -> pd.Series:
        return t.map(lambda x: "\n".join(kernels.clean_lines(x)))

    return _t(spark, sf, "documents").select("doc_id", clean("text").alias("lines"))


QUERIES = {
    f.__name__: f
    for f in (
        plain_text, text_hashes, line_markers, detect_lang, notices, outcomes, host_suffix_filter, host_rules, shard_filter, link_numbers, keywords, tidy_paths, contexts, unit_inputs, blind_codes, unit_algebra, norm_dates,
        translation_checks, translation_summary, translation_questions, query_fallback, glossary_hits, copied_translations, page_extract, kernel_lines,
    )
}

# what (?U)\s is in Java, for an engine whose \s is ASCII
_WS = "[ \\t\\n\\r\\f\\v\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_VI = T.VI_LETTERS
_QT = "qt as (select id as qid, trim(lang) as lang, min(trim(query)) as query from queries where id is not null and query is not null and lang is not null and trim(query) <> '' group by 1, 2)"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"


def _count(p: str, c: str = "s") -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


_NUM = "list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '\\d+(?:[.,]\\d+)*'), lambda x: replace(x, ',', '.')))"
_CHECKS = f"""with {_QT}, p as (select v.qid, v.query, coalesce(e.query, '') as en, coalesce(z.query, '') as zh from qt v left join qt e on e.qid = v.qid and e.lang = 'en' left join qt z on z.qid = v.qid and z.lang = 'zh' where v.lang = 'vi'),
c as (select qid, {_count('[一-鿿]', 'en')} = 0 and {_count('[' + _VI + ']', 'en')} = 0 as en_script, {_count('[一-鿿]', 'zh')} >= 2 and {_count('[一-鿿]', 'zh')} >= 0.3 * ({_count('[一-鿿]', 'zh')} + {_count('[A-Za-z0-9]+', 'zh')}) as zh_script,
  list_has_all({_NUM.format('en')}, {_NUM.format('query')}) as en_numbers, list_has_all({_NUM.format('zh')}, {_NUM.format('query')}) as zh_numbers, length(en) / greatest(1, length(query)) as en_ratio, length(zh) / greatest(1, length(query)) as zh_ratio from p)
"""
_D = ", ".join(f"'{s}'" for s in T.DONE)

SQL = {
    "plain_text": f"select id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^---$\\n?', '', 'g'), '(?m)^(?:#{{1,6}} |- )', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g') as plain from corpus",
    "text_hashes": f"select doc_id, md5(regexp_replace(lower(coalesce(text, '')), '{_WS}+', '', 'g'))[:16] as hash from documents",
    "line_markers": "with x as (select id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as no from corpus) select id, no, coalesce(regexp_extract(line, '^(#{1,6} |- )', 1), '') as marker, regexp_replace(line, '^(?:#{1,6} |- )', '') as content from x",
    "detect_lang": f"""with x as (select doc_id, coalesce(text, '')[:4000] as s, coalesce(source, '') as h, coalesce(lang, '')[:2] as two from documents),
y as (select *, {_count('[一-鿿]')} as han, {_count('[' + _VI + ']')} as vi, {_count('[A-Za-z]')} as latin from x)
select doc_id, case when han >= 10 and han > 2 * vi then 'zh' when vi >= 5 and vi >= 0.02 * latin then 'vi' when latin >= 100 and vi < 0.005 * latin and han < 10 then 'en' when h like '%.vn' then 'vi' when han > 0 or h like '%.cn' then 'zh' when two in ('vi', 'zh', 'en') then two else '' end as detected from y""",
    "notices": f"select id, session, length(text) <= 400 and (regexp_matches(text, '{NOTICE}') or regexp_matches(coalesce(title, ''), '{NOTICE}')) as notice from pages where text is not null",
    "outcomes": f"""select status, case when status in ('ok', 'empty', 'notice') then 'good' when status in ('gone', 'not_html', 'http_400', 'http_404', 'http_410', 'pm_missing', 'err_too_big') then 'benign' when status like 'blocked%' then 'block' else 'throttle' end as outcome,
  case when status = 'ok' then 0 when status = 'empty' then 1 when status = 'notice' then 2 when status in ({_D}) then 3 else 5 end as rank,
  case when status = 'ok' then 'ok' when status = 'empty' then 'short' when status in ('notice', 'boilerplate') then 'notice' when status in ('gone', 'http_404', 'http_410', 'http_400', 'not_html', 'pm_missing') then 'gone' when status = 'pending' then 'pending' else 'error' end as kind,
  status in ({_D}) as done, status <> 'http_429' and not starts_with(status, 'blocked_') as attempt, count(*) as n from pages where status is not null group by all""",
    "host_suffix_filter": f"select id, session, {_HOST} as h from pages where {_HOST} in ('suckhoe-fabilogadu.test', 'example') or {_HOST} like '%.suckhoe-fabilogadu.test' or {_HOST} like '%.example'",
    "host_rules": f"""with u as (select distinct url, {_HOST} as h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as p from pages)
select url, case when h = 'example' or h like '%.example' then 'knowledge' when (h = 'test' or h like '%.test') and p like '/qa/%' then 'qa' when h = 'test' or h like '%.test' then 'knowledge' when (h = 'invalid' or h like '%.invalid') and p like '/news/%' then 'news' else 'other' end as doc_type,
  case when h = 'suckhoe-fabilogadu.test' or h like '%.suckhoe-fabilogadu.test' then 'slow' when h = 'test' or h like '%.test' then 'test-zone' else h end as rate_group from u""",
    "shard_filter": "select id, session from pages where id % 4 = 1",
    "link_numbers": "select id, cast(id as varchar) as number from corpus",
    "keywords": "select distinct keywords, array_to_string(list_filter(list_transform(regexp_split_to_array(keywords, '[,，;；、|]'), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from pages where keywords <> ''",
    "unit_inputs": "select distinct qid, unit_id, md5(case when coalesce(lang, '') = '' then text else lang || chr(10) || text end) as input from qrels where text is not null",
    "blind_codes": "select qid, unit_id, md5('13:' || qid || ':' || unit_id)[:8] as code from judge_key",
    "unit_algebra": "select distinct unit_id || '_c2' as unit_id, regexp_replace(unit_id || '_c2', '_c\\d+$', '') as parent, split_part(unit_id, '_', 1) as doc from qrels",
    "contexts": r"""with h as (select id, coalesce(title, '') as t, list_filter(list_transform(regexp_extract_all(text, '(?m)^#{1,6} (.*)$', 1)[:3], lambda x: trim(x, ' ')), lambda x: x <> '') as hs from corpus)
select id, regexp_replace(left(array_to_string(list_concat(list_filter([t], lambda x: x <> ''), list_filter(hs, lambda x: x <> t and length(x) <= 100)), ' > '), 220), '\s+$', '') as ctx from h""",
    "tidy_paths": r"""with p as (select id, title, list_filter(list_transform(string_split(concat_ws(' > ', 'Trang chủ', section, title), ' > '), lambda x: regexp_replace(regexp_replace(x, '^[ >›»/|]+', ''), '[ >›»/|]+$', '')),
  lambda x: x <> '' and lower(x) not in ('trang chủ', 'trang chu', 'home', '首页', '主页', '网站首页', 'trang chính')) as p from corpus),
u as (select id, title, list_filter(p, lambda x, i: list_position(p, x) = i) as p from p),
c as (select id, case when len(p) > 0 and p[-1] = title then p[:len(p) - 1] else p end as p from u)
select id, array_to_string(p[:6], ' > ') as path from c""",
    "kernel_lines": r"""with t as (select doc_id, regexp_replace(regexp_replace(nfc_normalize(replace(coalesce(text, ''), chr(160), ' ')), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '\r\n?', chr(10), 'g') as t from documents),
l as (select doc_id, list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'), ' ')) as l from t),
b as (select doc_id, list_transform(l, lambda x: regexp_extract(x, '^(#{1,6} |- )?', 1) || trim(regexp_replace(x, '^(#{1,6} |- )', ''), '| ')) as l from l)
select doc_id, array_to_string(list_filter(l, lambda x: regexp_replace(x, '^(#{1,6} |- )', '') <> ''), chr(10)) as lines from b""",
    "date_values": r"""with r as (select distinct raw, replace(raw, chr(160), ' ') as t from (select published as raw from pages union all select modified from pages) where raw is not null and raw <> ''),
c as (select raw, [regexp_extract(t, '(?:^|\D)(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})(?:\D|$)', ['y', 'm', 'd']), regexp_extract(t, '(?i)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s*,?\s*năm\s+(\d{4})', ['d', 'm', 'y']),
  regexp_extract(t, '(?:^|\D)(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{4})(?:\D|$)', ['d', 'm', 'y']), regexp_extract(t, '(?i)(?:^|[^a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s+(\d{4})(?:\D|$)', ['m', 'd', 'y']),
  regexp_extract(t, '(?i)(?:^|\D)(\d{1,2})(?:st|nd|rd|th)?\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*,?\s+(\d{4})(?:\D|$)', ['d', 'm', 'y'])] as c, regexp_extract(trim(t), '^(\d{10})(?:\d{3})?$', 1) as stamp from r),
d as (select raw, case when stamp <> '' then [cast(to_timestamp(cast(stamp as bigint)) as date)] else list_transform(c, lambda x: try_cast(x.y || '-' || case when regexp_matches(x.m, '^\d') then lpad(x.m, 2, '0')
  else lpad(cast(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(x.m)) as varchar), 2, '0') end || '-' || lpad(x.d, 2, '0') as date)) end as d from c)
select raw, strftime(list_filter(d, lambda x: x >= date '1900-01-01' and x <= date '2027-01-02')[1], '%Y-%m-%d') as iso from d""",
    "norm_dates": "select o_orderkey, form, case when form < 6 or epoch(date_trunc('day', o_orderdate)) >= 1000000000 then strftime(o_orderdate, '%Y-%m-%d') end as iso from orders, range(7) as r(form)",
    "translation_checks": _CHECKS + "select qid, en_script, zh_script, en_numbers, zh_numbers, round(en_ratio, 6) as en_ratio, round(zh_ratio, 6) as zh_ratio, en_ratio < 0.5 as en_short, zh_ratio < 0.15 as zh_short from c",
    "translation_summary": _CHECKS + "select count(*) as n, count(*) filter (en_script) as en_script, count(*) filter (zh_script) as zh_script, count(*) filter (en_numbers) as en_numbers, count(*) filter (zh_numbers) as zh_numbers, round(median(en_ratio), 6) as en_ratio, round(median(zh_ratio), 6) as zh_ratio, count(*) filter (en_ratio < 0.5) as en_short, count(*) filter (zh_ratio < 0.15) as zh_short from c",
    "translation_questions": f"""with {_QT}, p as (select v.query, coalesce(e.query, '') as en, coalesce(z.query, '') as zh from qt v left join qt e on e.qid = v.qid and e.lang = 'en' left join qt z on z.qid = v.qid and z.lang = 'zh' where v.lang = 'vi'),
x as (select *, {_count('[?]', 'query')} as n, list_filter(list_distinct(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}]+')), lambda t: regexp_full_match(t, '[A-Z][A-Z0-9]+')) as acr from p)
select count(*) filter (n >= 2) as several, count(*) filter (n >= 2 and {_count('[?？]', 'en')} >= n) as en_questions, count(*) filter (n >= 2 and {_count('[?？]', 'zh')} >= n) as zh_questions, cast(sum(len(acr)) as bigint) as acronyms,
  cast(sum(len(list_filter(acr, lambda a: contains(lower(en), lower(a))))) as bigint) as en_acronyms, cast(sum(len(list_filter(acr, lambda a: contains(lower(zh), lower(a))))) as bigint) as zh_acronyms from x""",
    "query_fallback": f"with {_QT} select coalesce(a.qid, b.qid) as qid, coalesce(a.query, b.query) as query, case when a.query is not null then 'zh' else 'vi' end as used from (select * from qt where lang = 'zh') a full join (select * from qt where lang = 'vi') b on a.qid = b.qid",
}
