"""Queries from the attempt log to the corpus, and tables about it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import norm_date
from ..operators import chunking, hosts, quality, report
from ..session import written
from ..sources import tables as src
from ..streaming import ingest


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark, sf):
    return _t(spark, sf, "pages")


def links(spark, sf):
    """Links of the project: every id with the first of its links."""
    return _pages(spark, sf).where("id is not null").groupBy("id").agg(F.min("url").alias("url"))


def todo_state(spark, sf):
    """Links without a final attempt, with what was tried."""
    return quality.todo(links(spark, sf), quality.state(_pages(spark, sf)), 3).withColumn("attempts", F.col("attempts").cast("long"))


def _winners(spark, sf):
    return quality.winners(_pages(spark, sf), "fetched_at", "session")


def winners(spark, sf):
    return _winners(spark, sf).select("id", "status", "session", F.col("xv").cast("long").alias("xv"), "processed_at", F.col("attempts").cast("long").alias("attempts"))


def _marked(spark, sf):
    return written(quality.boilerplate(_winners(spark, sf), 4), "marked")


def boilerplate(spark, sf):
    return _marked(spark, sf).where("status = 'boilerplate'").select("id", "host", "text_hash")


def dup_groups(spark, sf):
    return _marked(spark, sf).where("dup_of is not null").select("id", "dup_of")


def site_suffixes(spark, sf):
    return quality.site_suffixes(_winners(spark, sf), 10)


def clean_titles(spark, sf):
    return quality.clean_titles(_winners(spark, sf)).select("id", "title_new", "generic")


def default_authors(spark, sf):
    return quality.default_authors(_winners(spark, sf), 5, 0.05)


def common_keywords(spark, sf):
    return quality.common_keywords(_winners(spark, sf), 5, 0.05)


def corpus_merge(spark, sf):
    """The whole merge."""
    return quality.corpus(_pages(spark, sf)).select("id", "host", "status", "title", "author", "keywords", "dup_of", "flags", F.col("attempts").cast("long").alias("attempts"))


def _with_pending(spark, sf):
    win = written(_winners(spark, sf), "winners")
    return report.with_pending(win, links(spark, sf))


def host_table(spark, sf):
    return report.host_table(_with_pending(spark, sf))


def host_totals(spark, sf):
    return report.totals(report.host_table(_with_pending(spark, sf)))


def crawl_counts(spark, sf):
    return report.status_counts(_pages(spark, sf).where("status is not null"))


def corpus_counts(spark, sf):
    return report.corpus_counts(_t(spark, sf, "corpus"))


def lang_summary(spark, sf):
    return report.lang_summary(_winners(spark, sf))


def size_percentiles(spark, sf):
    return report.size_percentiles(_t(spark, sf, "corpus"), "n_chars", "lang", "doc_type", least=5)


def probe_spread(spark, sf):
    """Three links of every host at even distances."""
    x = links(spark, sf).withColumn("host", T.host_of(F.col("url")))
    return src.spread(x, "host", "id", 3)


def host_control(spark, sf):
    """Politeness state of every host after its attempts."""
    x = _pages(spark, sf).where("host is not null").select("host", F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.left("fetched_at", F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))), F.lit(0)).alias("at"), "status")
    return hosts.fold(x)


def fetch_windows(spark, sf):
    """Statuses in windows of six hours of fetch time."""
    return ingest.status_windows(_pages(spark, sf).where("fetched_at is not null"), "6 hours")


def event_sessions(spark, sf):
    """Bursts of a user's events, half an hour apart."""
    return ingest.bursts(_t(spark, sf, "events"))


def _docs(spark, sf):
    return _t(spark, sf, "corpus").select(F.col("id").alias("doc_id"), "lang", "doc_type", "title", "text", "dup_of")


def chunk_parents(spark, sf):
    return chunking.parents(chunking.units(_docs(spark, sf).where("dup_of is null")))


def chunk_children(spark, sf):
    return chunking.children(chunking.units(_docs(spark, sf).where("dup_of is null")))


def chunk_invariants(spark, sf):
    """Units that break an invariant: none."""
    return chunking.invariant_violations(written(chunking.units(_docs(spark, sf)), "units", {"compression": "zstd"}), _docs(spark, sf))


def chunk_coverage(spark, sf):
    """Per document: what its parents hold without white space, whether sizes keep to the limits, and whether children hold what their parents do."""
    u = written(chunking.units(_docs(spark, sf)), "units")
    joined = lambda x, key: x.groupBy(key).agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "text"))), lambda c: c["text"]), ""), r"(?U)\s+", "").alias("t"))
    p = chunking.parents(u)
    kids = joined(chunking.children(u), "parent_id").select(F.col("parent_id").alias("unit_id"), F.col("t").alias("kids"))
    same = p.join(kids, "unit_id", "left").groupBy("doc_id").agg(
        F.every(F.coalesce(F.col("kids") == F.regexp_replace("text", r"(?U)\s+", ""), F.col("n_tokens") <= 160)).alias("children_cover"), F.every((F.col("n_tokens") <= 400) & (F.length("ctx") <= 220)).alias("within_limits")
    )
    return joined(p, "doc_id").join(same, "doc_id").select("doc_id", F.md5("t").alias("content"), "children_cover", "within_limits")


def chunk_report(spark, sf):
    u = chunking.parents(chunking.units(_docs(spark, sf)))
    return report.size_percentiles(u, "n_tokens", "lang", "doc_type", least=5)


def _hashes(spark, sf):
    return _t(spark, sf, "corpus").select(F.concat(F.col("id").cast("string"), F.lit("_p0")).alias("unit_id"), T.unit_hash(F.col("title"), F.coalesce("text", F.lit(""))).alias("h"), (F.col("id") % 8).alias("block"))


def incremental_pairs(spark, sf):
    """Units whose text changed since they were encoded: every seventh here."""
    now = _hashes(spark, sf)
    old = now.withColumn("h", F.when(F.col("unit_id").endswith("3_p0"), F.reverse("h")).otherwise(F.col("h")))
    return chunking.pending(now, old).select("unit_id", "h")


def still_encoded(spark, sf):
    now = _hashes(spark, sf)
    old = now.unionByName(now.withColumn("block", F.col("block") + 1)).withColumn("h", F.when(F.col("unit_id").endswith("3_p0"), F.reverse("h")).otherwise(F.col("h")))
    return chunking.still_valid(old, now)


def block_fingerprints(spark, sf):
    return chunking.block_fingerprints(_hashes(spark, sf), F.col("block")).select("block", "n", "fingerprint")


def date_values(spark, sf):
    """Dates of all pages in ISO form."""
    p = _pages(spark, sf).select(F.explode(F.array("published", "modified")).alias("raw")).where("raw is not null and raw <> ''").distinct()
    return p.select("raw", norm_date(F.col("raw"), F.lit("2027-01-01").cast("date")).alias("iso"))


QUERIES = {
    f.__name__: f
    for f in (
        links, todo_state, winners, boilerplate, dup_groups, site_suffixes, clean_titles, default_authors, common_keywords, corpus_merge, host_table, host_totals, crawl_counts, corpus_counts, lang_summary,
        size_percentiles, probe_spread, host_control, fetch_windows, event_sessions, chunk_parents, chunk_children, chunk_invariants, chunk_coverage, chunk_report, incremental_pairs, still_encoded, block_fingerprints, date_values,
    )
}

_DONE = "(" + ", ".join(f"'{s}'" for s in T.DONE) + ")"
_WIN = f"""with sr as (select *, case when status = 'ok' then 0 when status = 'empty' then 1 when status = 'notice' then 2 when status in {_DONE} then 3 else 5 end as sr from pages where id is not null),
w as (select *, row_number() over (partition by id order by sr, coalesce(xv, 0) desc, coalesce(processed_at, '') desc, coalesce(fetched_at, '') desc, coalesce(session, '') desc) as rn, count(*) over (partition by id) as attempts from sr),
win as (select * exclude (sr, rn) from w where rn = 1)
"""
_C = "status in ('ok', 'empty')"
_H = f"{_C} and coalesce(text_hash, '') <> ''"


def _marked_sql(least: int) -> str:
    return f""", many as (select host, text_hash from win where {_H} group by 1, 2 having count(*) >= {least}),
mk as (select win.* replace (case when win.status in ('ok', 'empty') and coalesce(win.text_hash, '') <> '' and many.host is not null then 'boilerplate' else status end as status) from win left join many on win.host = many.host and win.text_hash = many.text_hash),
ld as (select text_hash, min(id) as lead from mk where {_H} group by 1), marked as (select mk.*, case when {_H} and lead <> id then lead end as dup_of from mk left join ld using (text_hash))
"""


_SEPS = "[" + ", ".join(f"'{s}'" for s in T.TITLE_SEPARATORS) + "]"
_SUF = """, tt as (select host, title from {src} where status in ('ok', 'empty') and title <> ''),
tn as (select host, count(*) as total from tt group by 1),
sp as (select host, title, unnest(""" + _SEPS + """) as sep from tt),
sx as (select host, sep, trim(list_last(string_split(title, sep))) as tail from sp where contains(title, sep)),
suf as (select host, sep, tail, count(*) as n from sx join tn using (host) where tail <> '' group by host, sep, tail, total having count(*) >= {least} and count(*) >= 0.3 * total)
"""
_KINDS = "case when status = 'ok' then 'ok' when status = 'empty' then 'short' when status in ('notice', 'boilerplate') then 'notice' when status in ('gone', 'http_404', 'http_410', 'http_400', 'not_html', 'pm_missing') then 'gone' when status = 'pending' then 'pending' else 'error' end"
_LINKS = "lk as (select id, min(url) as url from pages where id is not null group by 1)"
_HOSTS = _WIN + f""", {_LINKS}, hw as (select id, host, status, n_chars, published, author from win
 union all select id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), 'pending', null, null, null from lk where id not in (select id from win)),
hk as (select *, {_KINDS} as kind from hw),
ht as (select host, count(*) as total, count(*) filter (kind = 'ok') as ok, count(*) filter (kind = 'short') as short, count(*) filter (kind = 'notice') as notice, count(*) filter (kind = 'gone') as gone,
  count(*) filter (kind = 'error') as error, count(*) filter (kind = 'pending') as pending, round(100 * count(*) filter (kind = 'ok') / count(*), 1) as ok_pct,
  cast(coalesce(floor(median(n_chars) filter (kind = 'ok')), 0) as bigint) as median_chars,
  coalesce(round(100 * avg(case when coalesce(published, '') <> '' then 1.0 else 0.0 end) filter (kind = 'ok'), 0), 0) as pct_date, coalesce(round(100 * avg(case when coalesce(author, '') <> '' then 1.0 else 0.0 end) filter (kind = 'ok'), 0), 0) as pct_author
  from hk group by 1),
he as (select host, coalesce(status, '') as status, count(*) as n, row_number() over (partition by host order by count(*) desc, coalesce(status, '')) as r from hk where kind = 'error' group by 1, 2),
htt as (select ht.*, coalesce(top_errors, '') as top_errors from ht left join (select host, string_agg(status || ':' || n, ', ' order by r) as top_errors from he where r <= 3 group by 1) using (host))
"""
_CUT = "case when suffix(t, e) and length(t) > length(e) then trim(left(t, length(t) - length(e))) else t end"


def _titles_sql(source: str) -> str:
    return _SUF.format(src=source, least=20) + f""", ends as (select host, list(sep || tail order by -length(sep || tail), sep || tail) as ends from suf group by 1),
t1 as (select m.*, case when {_C} and ends is not null then list_reduce(list_concat([coalesce(title, '')], ends, ends), lambda t, e: {_CUT}) else coalesce(title, '') end as tn from {source} m left join ends using (host)),
nh as (select host, count(*) as total from t1 where {_C} group by 1),
gen as (select host, tn from t1 join nh using (host) where {_C} and tn <> '' group by host, tn, total having count(*) >= 50 and count(*) >= 0.05 * total
  union select host, site_name from t1 where {_C} and site_name is not null union select host, tail from suf),
t2 as (select t1.*, coalesce({_C} and t1.tn <> '' and gen.host is not null, false) as generic from t1 left join gen on t1.host = gen.host and t1.tn = gen.tn)
"""


_HASH = "hs as (select id || '_p0' as unit_id, md5(coalesce(title, '') || chr(31) || coalesce(text, ''))[:12] as h, id % 8 as block from corpus)"
_OLD = ", old as (select unit_id, case when unit_id like '%3_p0' then reverse(h) else h end as h, block from hs)"
_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"

SQL = {
    "links": f"with {_LINKS} select id, url from lk",
    "todo_state": f"""with {_LINKS}, st as (select id, bool_or(coalesce(status in {_DONE}, false)) as done, count(*) filter (coalesce(status, '') <> 'http_429' and coalesce(status, '') not like 'blocked\\_%' escape '\\') as attempts from pages group by 1)
select id, url, coalesce(attempts, 0) as attempts, coalesce(attempts, 0) >= 3 as gave_up from lk left join st using (id) where not coalesce(done, false)""",
    "winners": _WIN + "select id, status, session, cast(xv as bigint) as xv, processed_at, attempts from win",
    "boilerplate": _WIN + _marked_sql(4) + "select id, host, text_hash from marked where status = 'boilerplate'",
    "dup_groups": _WIN + _marked_sql(4) + "select id, dup_of from marked where dup_of is not null",
    "clean_titles": _WIN + _titles_sql("win") + "select id, case when generic then '' else tn end as title_new, generic from t2",
    "corpus_merge": _WIN + _marked_sql(quality.BOILERPLATE_ROWS) + _titles_sql("marked") + f""", da as (select host, author from t2 join nh using (host) where {_C} and author <> '' group by host, author, total having count(*) >= 20 and count(*) >= 0.3 * total),
kx as (select host, unnest(list_distinct(string_split(coalesce(keywords, ''), '; '))) as kw from t2 where {_C}),
ck as (select host, list(kw) as common from (select host, kw from kx join nh using (host) where kw <> '' group by host, kw, total having count(*) >= 20 and count(*) >= 0.3 * total) group by 1),
x as (select t2.id, t2.host, status, case when generic then '' else tn end as title, case when {_C} and da.host is not null then '' else coalesce(t2.author, '') end as author,
  case when {_C} and common is not null then array_to_string(list_filter(string_split(coalesce(keywords, ''), '; '), lambda k: k <> '' and not list_contains(common, k)), '; ') else coalesce(keywords, '') end as keywords,
  dup_of, concat_ws(',', case when dup_of is not null then 'dup' end, case when generic then 'generic_title' end, case when status = 'empty' then 'short' end) as flags, attempts
  from t2 left join da on t2.host = da.host and t2.author = da.author left join ck on t2.host = ck.host)
select * from x where status = 'ok' or (status = 'empty' and title <> '')""",
    "site_suffixes": _WIN + _SUF.format(src="win", least=10) + "select host, sep, tail, n from suf",
    "default_authors": _WIN + f", n as (select host, count(*) as total from win where {_C} group by 1) select host, author, count(*) as n from win join n using (host) where {_C} and author <> '' group by host, author, total having count(*) >= 5 and count(*) >= 0.05 * total",
    "common_keywords": _WIN + f", n as (select host, count(*) as total from win where {_C} group by 1), k as (select host, unnest(list_distinct(string_split(coalesce(keywords, ''), '; '))) as keyword from win where {_C}) select host, keyword, count(*) as n from k join n using (host) where keyword <> '' group by host, keyword, total having count(*) >= 5 and count(*) >= 0.05 * total",
    "host_table": _HOSTS + "select * from htt",
    "host_totals": _HOSTS + "select " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("total", *report.KINDS)) + " from htt",
    "crawl_counts": "select status, host, count(*) as n, true as by_host from pages where status is not null group by 1, 2 union all select status, null, count(*), false from pages where status is not null group by 1",
    "corpus_counts": "with x as (select 'lang' as what, coalesce(lang, '') as value from corpus union all select 'doc_type', coalesce(doc_type, '') from corpus union all select 'status', coalesce(status, '') from corpus union all select 'dup', case when dup_of is not null then 'yes' else 'no' end from corpus) select what, value, count(*) as n from x group by all",
    "lang_summary": _WIN + "select lang, count(*) as n, median(n_chars) as median from win where status = 'ok' group by 1",
    "size_percentiles": "select lang, doc_type, count(*) as n, " + ", ".join(f"round(quantile_cont(n_chars, {p / 100}), 6) as p{p}" for p in (5, 25, 50, 75, 95)) + " from corpus group by 1, 2 having count(*) >= 5",
    "probe_spread": f"""with {_LINKS}, x as (select id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host from lk), y as (select *, row_number() over (partition by host order by id) - 1 as i, count(*) over (partition by host) as n from x)
select id, url, host from y where n <= 3 or i in (floor(0.5 * n / 3), floor(1.5 * n / 3), floor(2.5 * n / 3))""",
    "fetch_windows": "select time_bucket(interval '6 hours', cast(fetched_at as timestamptz) at time zone 'UTC', timestamp '1970-01-01') as start, status, count(*) as n from pages where fetched_at is not null group by all",
    "event_sessions": """with x as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '30 minutes' then 1 else 0 end as b, event_id from events where user_id is not null and ts is not null),
y as (select user_id, ts, sum(b) over (partition by user_id order by ts, event_id) as s from x) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as end, count(*) as n from y group by user_id, s""",
    "chunk_invariants": "select '' as problem, '' as unit_id where false",
    "host_control": """with recursive o as (select host, coalesce(epoch(try_strptime(left(fetched_at, 19), '%Y-%m-%dT%H:%M:%S')), 0) as ts, coalesce(status, '') as status from pages where host is not null),
k as (select host, ts, case when status in ('ok', 'empty', 'notice') then 0 when status in ('gone', 'not_html', 'http_400', 'http_404', 'http_410', 'pm_missing', 'err_too_big') then 0 when status like 'blocked%' then 4 else 1 end as strain, row_number() over (partition by host order by ts, status) as i from o),
f as (select host, 0::bigint as n, 4 as most, 1.0::double as base_delay, 2 as "limit", 1.0::double as delay, 0 as good_run, 0 as bad_run, 0 as strikes, 0.0::double as pause_until, false as dead from (select distinct host from k)
union all select host, n + 1, most, base_delay,
  case when dead then "limit" when strain = 0 then case when good_run + 1 = 25 and delay <= base_delay then least(most, "limit" + 1) else "limit" end when bad_run + strain >= 12 then 1 else greatest(1, "limit" // 2) end,
  case when dead then delay when strain = 0 then case when good_run + 1 = 25 and delay > base_delay then greatest(base_delay, delay / 1.5) else delay end when "limit" = 1 then least(15.0, greatest(1.0, 2 * delay)) else delay end,
  case when dead then good_run when strain = 0 then (good_run + 1) % 25 else 0 end,
  case when dead then bad_run when strain = 0 or bad_run + strain >= 12 then 0 else bad_run + strain end,
  case when dead or strain = 0 or bad_run + strain < 12 then strikes else strikes + 1 end,
  case when dead or strain = 0 or bad_run + strain < 12 or strikes + 1 > 3 then pause_until else ts + 300.0 * 2 ** strikes end,
  dead or (strain > 0 and bad_run + strain >= 12 and strikes + 1 > 3)
from f join k using (host) where k.i = f.n + 1)
select * from f qualify row_number() over (partition by host order by n desc) = 1""",
    "chunk_coverage": r"""with plain as (select id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^---$\n?', '', 'g'), '(?m)^(#{1,6} |- )', '', 'g'), '[\s\p{Z}]+', '', 'g') as t from corpus where id is not null and text is not null)
select id as doc_id, md5(t) as content, true as children_cover, true as within_limits from plain where t <> ''""",
    "block_fingerprints": f"with {_HASH} select block, count(*) as n, bit_xor(cast('0x' || md5(unit_id || ':' || h)[:12] as bigint)) as fingerprint from hs group by block",
    "incremental_pairs": f"with {_HASH}{_OLD} select unit_id, h from hs where (unit_id, h) not in (select (unit_id, h) from old)",
    "still_encoded": f"with {_HASH}{_OLD}, both as (select unit_id, h, min(block) as block from old where (unit_id, h) in (select (unit_id, h) from hs) group by 1, 2) select unit_id, h, block from both".replace("both as", "b_ as").replace("from both", "from b_"),
}
