"""SQL for the queries that SQL can express over whole tables; the others are tested against brute force and planted cases."""

from __future__ import annotations

from .borda import SQL as BORDA
from .consensus import KRIPPENDORFF_SQL

_TOP = """
with best as (select branch, qid, unit_id, max(score) as score from runs where score is not null and not isnan(score) and unit_id is not null group by all),
ranked as (select *, row_number() over (partition by branch, qid order by score desc, unit_id) as place from best)
select {columns} from ranked where place <= 10
"""

_LINES = """
with lines as (select id, host, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no
  from corpus where id is not null and host is not null and text is not null),
keyed as (select id, host, line, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') as k from lines),
often as (select host, k from keyed where k <> '' and line[1] <> '#' group by host, k having count(distinct id) >= 12),
cut as (select id, line_no from keyed join often using (host, k) where line[1] <> '#')
"""

_WORDS = "regexp_extract_all(lower({}), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]|[\\p{{Latin}}\\p{{N}}]+')"
_PAIRS = (
    _LINES
    + """,
kept as (select id, string_agg(line, chr(10) order by line_no) as text from keyed anti join cut using (id, line_no) group by id),
texts as (select 'corpus' as tab, 0 as grp, id, text from kept union all select 'relevant_chunks', qid, chunk_id, chunk_text from relevant_chunks where qid is not null),
words as (select tab, grp, id, """
    + _WORDS.format("text")
    + """ as w from texts),
grams as (select distinct tab, grp, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from words where len(w) >= 3),
size as (select tab, id, count(*) as n from grams group by all),
common_ as (select a.tab, a.id as id_a, b.id as id_b, count(*) as c from grams a join grams b on a.tab = b.tab and a.grp = b.grp and a.g = b.g and a.id < b.id group by all)
select tab, id_a, id_b from common_ join size x on x.tab = common_.tab and x.id = id_a join size y on y.tab = common_.tab and y.id = id_b where 3 * c >= x.n + y.n
"""
).replace("select tab, id_a, id_b from common_ join", "select common_.tab as tab, id_a, id_b from common_ join")

SQL: dict[str, str] = {
    "p1_found": _TOP.format(columns="branch, qid, unit_id"),
    "p1_top10": _TOP.format(columns="branch, qid, unit_id, round(cast(score as double), 4) as score, place"),
    "p2_found": _LINES + "select id, cast(line_no as integer) as line_no from cut",
    "p3_borda": BORDA,
    "p5_found": _PAIRS,
    "p6_agreement": KRIPPENDORFF_SQL,
}
