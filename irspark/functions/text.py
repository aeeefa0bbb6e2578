"""Scalar text functions as Column expressions; they stay in generated code.

Python's Unicode classes are written out for Java: (?U) makes \\s and \\w Unicode, (?md) makes ^ and $ stop at line feeds only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses of attempts.
DONE = ("ok", "empty", "notice", "gone", "not_html", "http_400", "http_404", "http_410", "pm_missing", "err_too_big")
RANKS = {"ok": 0, "empty": 1, "notice": 2}
OTHER_RANK = 5
GOOD = ("ok", "empty", "notice")
BENIGN = ("gone", "not_html", "http_400", "http_404", "http_410", "pm_missing", "err_too_big")

# Letters that only Vietnamese has, as a class; one range, since a class of many single letters is slow.
VI_LETTERS = "ăâđêôơưĂÂĐÊÔƠƯẠ-ỹ"
# Separators between a title and the name of its site, in the order in which they are tried.
TITLE_SEPARATORS = (" | ", " • ", " - ", " – ", " — ", " _ ", "_", " :: ", " » ", " · ", "--", "-", "|")
# First parts of a path that say nothing.
HOME = ("trang chủ", "trang chu", "home", "首页", "主页", "网站首页", "trang chính")


def done(status: Column) -> Column:
    return F.coalesce(status.isin(*DONE), F.lit(False))


def counts_as_attempt(status: Column) -> Column:
    """Being told to wait isn't an attempt."""
    s = F.coalesce(status, F.lit(""))
    return (s != "http_429") & ~s.startswith("blocked_")


def status_rank(status: Column) -> Column:
    out = F.when(F.coalesce(status.isin(*DONE), F.lit(False)), 3).otherwise(OTHER_RANK)
    for k, v in RANKS.items():
        out = F.when(F.coalesce(status, F.lit("")) == k, v).otherwise(out)
    return out


def outcome(status: Column) -> Column:
    """good, benign, block or throttle."""
    s = F.coalesce(status, F.lit(""))
    return F.when(s.isin(*GOOD), "good").when(s.isin(*BENIGN), "benign").when(s.startswith("blocked"), "block").otherwise("throttle")


def outcome_of(status: str | None) -> str:
    """outcome for code that runs in Python."""
    return "good" if status in GOOD else "benign" if status in BENIGN else "block" if (status or "").startswith("blocked") else "throttle"


def host_kind(status: Column) -> Column:
    """Column of the host table a status counts in."""
    s = F.coalesce(status, F.lit(""))
    return (
        F.when(s == "ok", "ok").when(s == "empty", "short").when(s.isin("notice", "boilerplate"), "notice")
        .when(s.isin("gone", "http_404", "http_410", "http_400", "not_html", "pm_missing"), "gone").when(s == "pending", "pending").otherwise("error")
    )


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def host_matches(host: Column, names: list[str]) -> Column:
    """The host is one of names or lies below one."""
    return reduce(Column.__or__, [(host == n) | host.endswith("." + n) for n in names], F.lit(False))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str | None, str]], default: Column | str) -> Column:
    """Value of the first rule (host suffix, path pattern or None, value) that matches."""
    out = default if isinstance(default, Column) else F.lit(default)
    for suffix, pattern, value in reversed(rules):
        ok = host_matches(host, [suffix])
        out = F.when(ok & path.rlike(pattern) if pattern else ok, value).otherwise(out)
    return out


def number_after(url: Column, host: str) -> Column:
    """Digits that follow the host in a link, null if there are none."""
    return F.when(url.rlike(rf"{host}/(\d+)"), F.regexp_extract(url, rf"{host}/(\d+)", 1))


def route(url: Column) -> Column:
    """bibliography for records that are fetched in batches by number, else web."""
    return F.when(F.coalesce(host_of(url), F.lit("")) == "pubmed.ncbi.nlm.nih.gov", "bibliography").otherwise("web")


def in_shard(id: Column, i: int, n: int) -> Column:
    if not 0 <= i < n:
        raise ValueError(f"shard {i} of {n}")
    return F.pmod(id, F.lit(n)) == i


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def to_plain(text: Column) -> Column:
    """Without line markers and rules."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?md)^---$\n?", "")
    return strip(F.regexp_replace(t, r"(?md)^(?:#{1,6} |- )", ""))


def marker(line: Column) -> Column:
    return F.regexp_extract(line, r"^(#{1,6} |- )?", 1)


def content(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:#{1,6} |- )", "")


def text_hash(plain: Column) -> Column:
    """16 digits that ignore case and white space."""
    return F.left(F.md5(F.regexp_replace(F.lower(F.coalesce(plain, F.lit(""))), r"(?U)\s+", "")), F.lit(16))


def unit_hash(ctx: Column, text: Column) -> Column:
    return F.left(F.md5(F.concat(F.coalesce(ctx, F.lit("")), F.lit("\x1f"), text)), F.lit(12))


def unit_input(ctx: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(ctx, F.lit("")), text)


def context(title: Column, path: Column, section: Column | None = None, most: int = 220) -> Column:
    """Title and headings joined; long headings and repeats of the title are left out."""
    t = F.coalesce(title, F.lit(""))
    heads = F.filter(path, lambda x: (x != "") & (x != t) & (F.length(x) <= 100))
    parts = F.concat(F.array(F.nullif(section, F.lit(""))) if section is not None else F.array().cast("array<string>"), F.array(F.nullif(t, F.lit(""))), heads)
    return F.regexp_replace(F.left(F.array_join(parts, " > "), F.lit(most)), r"(?U)\s+$", "")


def detect_lang(text: Column, host: Column, hint: Column, hosts_vi: tuple[str, ...] = (), sample: int | None = 4000) -> Column:
    """zh, vi, en or empty, by counts of letters among the first sample characters, of which the label is defined, or of the whole text (None); then
    by host, then by hint."""
    s = F.coalesce(text, F.lit("")) if sample is None else F.left(F.coalesce(text, F.lit("")), F.lit(sample))
    # what is left without the others is as long as their number; no list of matches is built
    han, vi, latin = (F.length(F.regexp_replace(s, f"[^{p}]+", "")) for p in ("一-鿿", VI_LETTERS, "A-Za-z"))
    h, two = F.coalesce(host, F.lit("")), F.left(F.coalesce(hint, F.lit("")), F.lit(2))
    # fixed values: the least counts and shares of letters for each language
    return (
        F.when((han >= 10) & (han > 2 * vi), "zh").when((vi >= 5) & (vi >= 0.02 * latin), "vi").when((latin >= 100) & (vi < 0.005 * latin) & (han < 10), "en")
        .when(h.endswith(".vn") | h.isin(*hosts_vi), "vi").when((han > 0) | h.endswith(".cn"), "zh").when(two.isin("vi", "zh", "en"), two).otherwise("")
    )


def is_notice(title: Column, text: Column, pattern: str, most: int = 400) -> Column:
    """Short text that, or whose title, matches the phrases of notices."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) <= most) & (t.rlike(pattern) | F.coalesce(title, F.lit("")).rlike(pattern))


def split_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,，;；、|]"), lambda x: strip(x)), lambda x: x != "")


def tidy_path(parts: Column, title: Column) -> Column:
    """Parts of a breadcrumb: trimmed, without home and repeats, without the title at its end, six at most."""
    p = F.transform(parts, lambda x: F.regexp_replace(x, r"^[ >›»/|]+|[ >›»/|]+$", ""))
    p = F.array_distinct(F.filter(p, lambda x: (x != "") & ~F.lower(x).isin(*HOME)))
    p = F.when((F.size(p) > 0) & (F.element_at(p, -1) == title), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
    return F.array_join(F.slice(p, 1, 6), " > ")


def after_last(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def numbers(text: Column) -> Column:
    """Set of the numbers, decimal commas as points."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def numbers_kept(source: Column, target: Column) -> Column:
    return F.size(F.array_except(numbers(source), numbers(target))) == 0


def script_ok(text: Column, lang: Column) -> Column:
    """Whether a translation is in the script of its language."""
    t = F.coalesce(text, F.lit(""))
    han, words = F.regexp_count(t, F.lit("[一-鿿]")), F.regexp_count(t, F.lit("[A-Za-z0-9]+"))
    return F.when(lang == "zh", (han >= 2) & (han >= 0.3 * (han + words))).when(lang == "en", (han == 0) & (F.regexp_count(t, F.lit(f"[{VI_LETTERS}]")) == 0)).otherwise(F.lit(True))


def head_term(term: Column) -> Column:
    """First variant of a term, without brackets."""
    return strip(F.regexp_replace(F.regexp_extract(F.coalesce(term, F.lit("")), r"^([^;/；]*)", 1), r"[(（][^)）]*[)）]", ""))


def code(qid: Column, unit: Column, salt: str) -> Column:
    """Blind code of a judging item."""
    return F.left(F.md5(F.concat_ws(":", F.lit(salt), qid.cast("string"), unit)), F.lit(8))


def blocked_notice(status: Column, title: Column, text: Column, pattern: str) -> Column:
    """A notice whose phrases ask for proof of being human is a block, which has its own rules for trying again."""
    words = F.concat_ws(" ", title, text)
    return F.when((status == "notice") & words.rlike(pattern), "blocked_notice").otherwise(status)
