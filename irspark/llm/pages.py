"""Lines of rendered pages: a block tree, a linear classifier for what lines and fields are, residue pages, and the main body.

The texts of the project are rendered already, so a page's tree is rebuilt from its line markup: a heading opens a section, which ends at the next heading
of its level or above; items imply a list and rows of as many cells a table, which end at the first line of another kind; a rule or a blank line ends
both; every other line is a paragraph. Visibility rules decide which blocks are emitted; lists and tables are decided as a whole, but for lines that are the host's. The rules use statistics over all pages
(in how many pages of its host a line's letters stand) and the classifier. blocks() lays out what is visible: a blank line between blocks,
items under each other, table cells padded to the width of their column.

The classifier is a regularised multinomial logistic regression over hashed word n-grams, line length and title features. Its
labels are weak: lines of long pages that were fetched are article, lines of short pages whose status is a failure, or that hold a
phrase of PHRASES, are residue, lines that stand in many sampled pages of their host are frame. It is fitted on about
TRAIN_ROWS rows and half as many that the weak labels call residue, chosen by a hash of their id, of at most TRAIN_CHARS characters each. A second, binary one
sees every span in brackets or signs of its kind (its delimiters, the shape and n-grams of its content, its length and place) and tells unfilled template
fields from others; its weak labels are the forms FIELD, on about FIELD_ROWS rows. validation() leaves a fifth of the hosts out
of both fits and reports the accuracy on their lines and spans.

Defined results: null ids are left out; rows with null or empty text have no lines; repeated rows change nothing, as results are
distinct and statistics count ids; rows without any article line are no cases of the main body, whose text is then empty.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_join, written
from . import vec
from .common import batch, i64

TRAIN_ROWS, TRAIN_CHARS, FIELD_ROWS = 3000, 20_000, 10_000
BUCKETS = 1 << 16
ARTICLE, FRAME, RESIDUE = 0, 1, 2
LONG_PAGE, SHORT_PAGE = 600, 500
#: A line is the host's if it stands in this share of the host's ids, and in so many at least.
HOST_SHARE, HOST_LEAST = 0.04, 4

# Statuses that mean a failed fetch, and phrases of error pages, script demands and filler, for the weak labels.
FAILED = ("notice", "boilerplate", "gone", "http_404", "http_410", "http_429", "http_500", "http_503", "blocked_notice")
PHRASES = (
    r"(?i)enable (?:javascript|scripts)|javascript is (?:required|disabled)|page (?:was )?not found|are you human|not a robot|captcha|access denied|service unavailable"
    r"|under (?:construction|maintenance)|coming soon|lorem ipsum|không tìm thấy|bảo trì|đang cập nhật|请启用|未找到|验证您是真人|正在建设|Traceback|SQLSTATE|NullPointerException|Undefined index|upstream timed out"
)
# Forms of unfilled template fields, for the weak labels. Fields hold names, not numbers or operators.
FIELD = (
    r"(?=[{$#<\[@_%【])(?:\{\{[^{}]*\p{L}[^{}]*\}\}|[$#]\{\s*\p{L}[^{}]*\}|<%[^<>]*\p{L}[^<>]*%>|\{%[^{}]*\p{L}[^{}]*%\}|\[\[[^\[\]]*\p{L}[^\[\]]*\]\]|<<[^<>]*\p{L}[^<>]*>>"
    r"|@@\p{L}[\p{L}\p{M}\p{N}_. ]*@@|__\p{L}[\p{L}\p{M}\p{N}. ]*(?:_[\p{L}\p{N}.]+)*__|%\p{Lu}[\p{Lu}\p{N}_.]{2,}%|\{\p{L}[\p{L}\p{M}\p{N}_.]*(?: \p{L}[\p{L}\p{M}\p{N}_.]*){0,3}\}"
    r"|\[\p{Lu}\p{Lu}+(?: \p{Lu}+)+\]|\[(?:请)?(?:输入|填写|插入|在此)[^\[\]]{1,20}\]|【(?:请)?(?:输入|填写|插入)?[^【】，。；！？\p{N}]{1,12}】|<\p{Ll}\p{L}*(?: \p{Ll}+){0,3}>|<\p{IsHan}{2,10}>)"
)

# Spans that may be a field.
SPAN = re.compile(r"[$#]?\{{1,2}[^{}\n]{1,60}\}{1,2}|<{1,2}[^<>\n]{1,60}>{1,2}|\[{1,2}[^\[\]\n]{1,60}\]{1,2}|@@[^@\n]{1,60}@@|__[^\n]{1,40}?__|%[^%\s]{2,40}%|【[^【】\n]{1,40}】")
SPAN_BUCKETS = 1 << 13

_END = np.array([ord(c) for c in ".!?。！？;；:：”\"）)"], np.uint32)
_ASK = np.array([ord(c) for c in "?？"], np.uint32)
_CRUMB = np.array([ord(c) for c in "›»/>→"], np.uint32)


def page_lines(cp: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All lines with the facts that their form shows; spaces around a line are left out."""
    t = vec.tables()
    doc, no, start, end = vec.lines_of(cp, off)
    space = np.isin(cp, (32, 9, 13, 160, 0x3000, 0x200B))
    solid = np.flatnonzero(~space & (cp != 10))
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end) - 1
    full = b >= a
    doc, no, s, e = doc[full], no[full], solid[a[full]] if full.any() else start[full], solid[b[full]] + 1 if full.any() else end[full]
    alpha = t["alpha"](cp)
    n_alpha = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(alpha, out=n_alpha[1:])
    pre = vec.prefix(t["lower"](cp[alpha]))
    la, lb = n_alpha[s], n_alpha[e]

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[e] - c[s]

    nxt, prv = np.append(cp[1:], 10) if len(cp) else cp, np.append(10, cp[:-1]) if len(cp) else cp
    first, last = cp[s] if len(s) else np.zeros(0, np.uint32), cp[np.maximum(e - 1, 0)] if len(s) else np.zeros(0, np.uint32)
    second = np.where(e - s > 1, cp[np.minimum(s + 1, max(len(cp) - 1, 0))], 0) if len(s) else first
    third = np.where(e - s > 2, cp[np.maximum(e - 3, 0)], 0) if len(s) else first
    return {
        "doc": doc, "no": no, "start": s, "end": e, "letters": lb - la, "hash": vec.span_hash(pre, la, lb),
        "heading": first == 35, "item": (np.isin(first, (45, 42, 0x2022)) & (second == 32)), "rule": (first == 45) & (lb == la),
        "cells": count((cp == 124) & (nxt == 32) & (prv == 32)), "crumbs": count(np.isin(cp, _CRUMB) & (nxt == 32) & (prv == 32)),
        "digits": count(t["digit"](cp)), "stop": np.isin(last, _END), "ask": np.isin(last, _ASK), "cut": (last == 0x2026) | ((last == 46) & (third == 46)),
        "arrow": (first == 62) & (second == 62),
    }


def _grams(cp: np.ndarray, off: np.ndarray, ln: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, line) of the word 1-, 2- and 3-grams. Numbers and long capitalised words become placeholders."""
    w = vec.words_of(cp, off)
    if not len(w["hash"]) or not len(ln["doc"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = vec.tables()
    line = np.searchsorted(ln["start"], w["start"], "right") - 1
    name = (w["end"] - w["start"] >= 7) & t["upper"](cp[w["start"]]) & ~t["upper"](cp[np.minimum(w["start"] + 1, len(cp) - 1)])
    h = np.where(t["digit"](cp[w["start"]]), np.uint64(1), np.where(name, np.uint64(2), w["hash"]))
    out_h, out_l = [], []
    for k in (1, 2, 3):
        if len(h) < k:
            break
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j]
        ok = line[: len(h) - k + 1] == line[k - 1 :]
        out_h.append((vec.mix(acc[ok]) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64)
        out_l.append(line[: len(h) - k + 1][ok])
    h, d = np.concatenate(out_h), np.concatenate(out_l)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def _features(cp, off, ln, titles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, line, weight, line starts). Buckets below 64 are the bias, length and title features."""
    h, d = _grams(cp, off, ln)
    n = len(ln["doc"])
    size = np.bincount(d, minlength=n)
    length = np.minimum(np.log2(np.maximum(ln["letters"], 1)).astype(np.int64), 9)
    extra = np.stack([np.zeros(n, np.int64), 1 + length, 12 + titles[ln["doc"]], 20 + ln["stop"] + 2 * (ln["cells"] > 0) + 4 * ln["heading"] + 8 * ln["item"]], axis=1)
    b = np.concatenate([h, extra.ravel()])
    line = np.concatenate([d, np.repeat(np.arange(n), 4)])
    wt = np.concatenate([1 / np.sqrt(np.maximum(size[d], 1)), np.tile([0.3, 0.3, 0.15, 0.2], n)])
    order = np.argsort(line, kind="stable")
    return b[order], line[order], wt[order].astype(np.float32), np.searchsorted(line[order], np.arange(n))


def _scores(weights: np.ndarray, b, line, wt, at) -> np.ndarray:
    if not len(at):
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.stack([np.add.reduceat(weights[b, k] * wt, at) for k in range(weights.shape[1])], axis=1)


#: Kinds of titles: null or empty, number or error word, the site's name, any other.
def title_kind(title: str = "title", site: str = "site_name"):
    t = F.trim(F.coalesce(F.col(title), F.lit("")))
    return F.when(t == "", 0).when(t.rlike(r"(?i)^(?:\d{3}\b.*|error|lỗi|错误|not found)$"), 1).when(F.lower(t) == F.lower(F.trim(F.coalesce(F.col(site), F.lit("")))), 2).otherwise(3)


def bare_title(title: str = "title"):
    """Title without the site's name at its end."""
    return F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"\s[|–-]\s[^|–-]*$", "")


def fit(pages: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 60, seed: int = 3, held_out: bool = False) -> dict:
    """Weights of the classifier; with held_out a fifth of the hosts aren't trained on, and accuracy is that on their lines."""
    have = pages.where((F.length("text") <= TRAIN_CHARS) & F.expr("id is not null and text <> ''")).select("id", "session", "host", "status", "text", title_kind().alias("kind"), ((F.length("text") < SHORT_PAGE) & F.col("text").rlike(PHRASES)).alias("phrase"))
    weak = (F.col("status").isin(*FAILED) | F.col("phrase")) & (F.length("text") < SHORT_PAGE)
    have = have.withColumn("weak", F.coalesce(weak, F.lit(False)))
    total, failed = have.agg(F.count("*"), F.count_if("weak")).first()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    have = have.where((place < int((1 << 20) * min(1, rows / max(total, 1)))) | (F.col("weak") & (place < int((1 << 20) * min(1, rows / 2 / max(failed, 1))))))
    p = have.drop("weak").toPandas().drop_duplicates(["id", "session"]).sort_values(["id", "session"], kind="stable").reset_index(drop=True)
    kinds = p["kind"].to_numpy()
    # slice by slice, so that the driver holds no more than the lines' facts and n-grams
    parts, grams, lines_before, rows_before = [], [], 0, 0
    texts = pa.RecordBatch.from_arrays([pa.array(p["text"], pa.large_string())], ["text"])
    for piece in vec.slices(iter([texts]), "text"):
        cp, off = vec.codepoints(piece.column("text"))
        ln = page_lines(cp, off)
        b, line, wt, _ = _features(cp, off, ln, kinds[rows_before : rows_before + piece.num_rows])
        grams.append((b.astype(np.int32), (line + lines_before).astype(np.int32), wt))
        lines_before += len(ln["doc"])
        parts.append({k: v for k, v in ln.items() if k not in ("start", "end")} | {"doc": ln["doc"] + rows_before, "chars": np.diff(off)[ln["doc"]]})
        rows_before += piece.num_rows
    empty = {"weights": np.zeros((BUCKETS, 3), np.float32), "accuracy": float("nan"), "lines": 0}
    if not lines_before:
        return empty
    ln = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
    b, line, wt = (np.concatenate([x[i] for x in grams]) for i in range(3))
    del grams, parts
    n = len(ln["doc"])
    host = p["host"].fillna("").astype("category").cat.codes.to_numpy().astype(np.int64)[ln["doc"]]
    ids = p["id"].to_numpy()[ln["doc"]]
    key = vec.mix(ln["hash"] + host.astype(np.uint64) * vec.BASE)
    u, inv = np.unique(key, return_inverse=True)
    pair = np.unique(np.stack([inv, ids]), axis=1)
    seen = np.bincount(pair[0], minlength=len(u))[inv]
    per_host = p.groupby(p["host"].fillna(""))["id"].nunique()
    n_host = per_host.to_numpy()[host]
    often = (seen >= np.maximum(4, 0.08 * n_host)) & ~ln["heading"]
    chars = ln["chars"]
    status, phrase = p["status"].fillna("").to_numpy()[ln["doc"]], p["phrase"].to_numpy()[ln["doc"]]
    label = np.full(n, -1)
    label[(status == "ok") & (chars > LONG_PAGE) & ~often & (ln["stop"] | ln["item"] | (ln["cells"] > 1)) & ~ln["cut"] & (ln["letters"] >= 8)] = ARTICLE
    label[(np.isin(status, FAILED) | phrase) & (chars < SHORT_PAGE) & ~often & (ln["letters"] > 0)] = RESIDUE
    label[often & (ln["letters"] > 0)] = FRAME
    used = np.flatnonzero(label >= 0)
    # as many lines of each class as of the rarest, three times over at most
    least = max(500, 3 * min((np.bincount(label[used], minlength=3)[k] for k in range(3)), default=0))
    rng = np.random.default_rng(seed)
    used = np.sort(np.concatenate([rng.permutation(used[label[used] == k])[:least] for k in range(3)]))
    pick = np.isin(line, used)
    b, line, wt = b[pick], np.searchsorted(used, line[pick]), wt[pick]
    at = np.searchsorted(line, np.arange(len(used)))
    y = np.eye(3, dtype=np.float32)[label[used]]
    unseen = (host[used] % 5 == 0) & held_out
    train = ~unseen
    y[unseen] = 0

    def learn(mask: np.ndarray, target: np.ndarray) -> np.ndarray:
        w, acc = np.zeros((BUCKETS, 3), np.float32), np.full((BUCKETS, 3), 1e-6, np.float32)
        for _ in range(rounds):
            s = _scores(w, b, line, wt, at)
            s = np.exp(s - s.max(axis=1, keepdims=True))
            g = (s / s.sum(axis=1, keepdims=True) - target) * mask[:, None]
            for k in range(3):
                grad = np.bincount(b, g[line, k] * wt, BUCKETS).astype(np.float32) + 0.02 * w[:, k]
                acc[:, k] += grad * grad
                w[:, k] -= 0.5 * grad / np.sqrt(acc[:, k])
        return w

    w = learn(train, y)
    right = _scores(w, b, line, wt, at).argmax(axis=1) == label[used]
    return {"weights": w, "accuracy": float(right[unseen].mean()) if unseen.any() else float("nan"), "lines": len(used)}


def _shape(s: str) -> str:
    """Kinds of characters in order, runs as one."""
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "z" if c.isalpha() else c for c in s]
    return "".join(c for i, c in enumerate(kind) if not i or c != kind[i - 1])


def span_features(text: str, m: re.Match) -> list[int]:
    """Buckets of a span: delimiters, shape, length, n-grams of its content, and whether it stands alone."""
    span = m[0]
    a = re.match(r"[^\w\s]+|_+", span)[0]
    e = re.search(r"(?:[^\w\s]+|_+)$", span)[0]
    inner = span[len(a) : len(span) - len(e)] if len(span) > len(a) + len(e) else ""
    shape, words = _shape(inner), re.findall(r"[^\W_]+", inner.lower())
    line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip() + text[m.end() : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1].strip()
    found = ["bias", "d" + a + e, "s" + shape, "ds" + a + shape, f"n{a}{min(len(inner), 20)}", f"w{a}{min(len(words), 6)}", f"alone{a}{not line}", "digit" + a * bool(re.search(r"\d", inner)), "stop" + a * bool(re.search(r"[,.;:!?，。；！？=|/]", inner))]
    found += ["u" + w for w in words] + ["b" + x + " " + y for x, y in zip(words, words[1:])] + ["c" + inner[i : i + 3].lower() for i in range(len(inner) - 2)]
    return [zlib.crc32(x.encode()) % SPAN_BUCKETS for x in found]


def fit_fields(pages: DataFrame, rows: int = FIELD_ROWS, rounds: int = 120, held_out: bool = False) -> dict:
    """Weights of the classifier of spans; with held_out a fifth of the hosts aren't trained on, and accuracy is that on their spans."""
    total = pages.where("text <> ''").count()
    some = pages.where((F.length("text") <= TRAIN_CHARS) & F.col("text").rlike(r"[{<\[【@_%]") & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * min(1, rows / max(total, 1)))))
    p = some.select(F.coalesce("host", F.lit("")).alias("host"), "text", F.regexp_extract_all("text", F.lit(FIELD), F.lit(0)).alias("fields")).distinct().sort("host", "text").toPandas()
    b, at, label, unseen, keep = [], [], [], [], set()
    for host, text, fields in zip(p["host"], p["text"], p["fields"]):
        fields = set(fields)
        for m in SPAN.finditer(text):
            x = span_features(text, m)
            key = (host, *x)
            if key not in keep:  # a span that a host repeats says the same
                keep.add(key)
                at.append(len(b))
                b += x
                label.append(m[0] in fields or any(f in m[0] for f in fields if len(f) > 3))
                unseen.append(held_out and zlib.crc32(host.encode()) % 5 == 0)
    if not label:
        return {"weights": np.zeros(SPAN_BUCKETS, np.float32), "accuracy": float("nan"), "spans": 0}
    b, at, label, unseen = np.array(b), np.array(at), np.array(label), np.array(unseen)
    row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(b))))
    w, acc = np.zeros(SPAN_BUCKETS), np.full(SPAN_BUCKETS, 1e-6)
    share = max(label[~unseen].mean() if (~unseen).any() else 0.5, 0.01)
    weight = np.where(label, 0.5 / share, 0.5 / max(1 - share, 0.01)) * ~unseen
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.add.reduceat(w[b], at))) - label) * weight
        grad = np.bincount(b, g[row], SPAN_BUCKETS) + 0.01 * w
        acc += grad * grad
        w -= 0.3 * grad / np.sqrt(acc)
    right = (np.add.reduceat(w[b], at) > 0) == label
    return {"weights": w.astype(np.float32), "accuracy": float(right[unseen].mean()) if unseen.any() else float("nan"), "spans": len(at)}


def _has_field(texts: pa.Array, cp: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which texts hold a span that the classifier takes for a field."""
    nxt = np.append(cp[1:], 0) if len(cp) else cp
    alpha = vec.tables()["alpha"](nxt)
    may = np.isin(cp, (0x7B, 0x3C, 0x5B, 0x3010)) | ((cp == 64) & (nxt == 64)) | ((cp == 95) & (nxt == 95)) | ((cp == 37) & alpha)
    out = np.zeros(len(off) - 1, bool)
    for i in np.unique(np.searchsorted(off, np.flatnonzero(may), "right") - 1).tolist():
        text = texts[i].as_py()
        out[i] = any(weights[span_features(text, m)].sum() > 0 for m in SPAN.finditer(text))
    return out


def validation(pages: DataFrame) -> DataFrame:
    """(classifier, cases, accuracy): accuracy of both classifiers on the weak labels of hosts that they weren't fitted on; none without cases."""
    a, b = fit(pages, held_out=True), fit_fields(pages, held_out=True)
    rows = [("lines", a["lines"], round(a["accuracy"], 4)), ("fields", b["spans"], round(b["accuracy"], 4))]
    rows = [r for r in rows if r[1]]
    return pages.sparkSession.createDataFrame(rows, "classifier string, cases long, accuracy double")


@dataclass
class Block:
    """A node of a page's tree: page, section, heading, list, table or paragraph, with its lines (number, text)."""

    kind: str
    level: int = 0
    lines: list[tuple[int, str]] = field(default_factory=list)
    children: list[Block] = field(default_factory=list)


def block_tree(text: str) -> Block:
    """Tree of a rendered page. Sections, lists and tables are implied by their lines and end where another kind of line begins."""
    root = Block("page")
    path = [root]  # open sections, the innermost last
    run: Block | None = None  # the list or table that may go on
    for no, raw in enumerate(text.split("\n")):
        line = raw.strip()
        head = re.match(r"(#{1,6})\s", line)
        kind = "heading" if head else "list" if re.match(r"[-*•] ", line) else "table" if " | " in line else "paragraph"
        if not line or re.fullmatch(r"-{3,}", line):
            run = None
        elif head:
            run = None
            while path[-1].level >= len(head[1]):
                path.pop()
            section = Block("section", len(head[1]), children=[Block("heading", len(head[1]), [(no, line)])])
            path[-1].children.append(section)
            path.append(section)
        elif run is not None and run.kind == kind and run.level == (line.count(" | ") if kind == "table" else 0):
            run.lines.append((no, line))
        else:
            block = Block(kind, line.count(" | ") if kind == "table" else 0, [(no, line)])
            path[-1].children.append(block)
            run = block if kind != "paragraph" else None
    return root


def _width(s: str) -> int:
    """Columns of a text, of which a wide character takes two."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def layout(block: Block, hidden: set[int]) -> list[str]:
    """Text of the visible blocks in order."""
    lines = [x for no, x in block.lines if no not in hidden]
    if block.kind == "table" and len(lines) > 1:
        rows = [[c.strip() for c in x.split("|")] for x in lines]
        wide = [max(_width(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
        lines = [" | ".join(c + " " * (wide[k] - _width(c)) for k, c in enumerate(r)).rstrip() for r in rows]
    return ["\n".join(lines)] * bool(lines) + [x for c in block.children for x in layout(c, hidden)]


def main_body(text: str | None, hidden: list[int] | None) -> str | None:
    """A page's text without the hidden lines, laid out; None for no text."""
    return None if text is None else "\n\n".join(layout(block_tree(text), set(() if hidden is None else hidden)))


LINES = "id long, session string, hk long, line_no int, block int, lh long, cls int, margin float, form int, own boolean"
# what a line's form says about it
_PLAIN, _ARTICLE_FORM, _SENTENCE, _ROW, _FRAME_FORM = 0, 1, 2, 3, 4


def _line_maker(weights: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = vec.tables()
        for b in vec.slices(batches, "text"):
            cp, off = vec.codepoints(b.column("text"))
            ln = page_lines(cp, off)
            if not len(ln["doc"]):
                continue
            s = _scores(weights, *_features(cp, off, ln, b.column("kind").to_numpy(zero_copy_only=False)))
            cls = s.argmax(axis=1)
            own = np.zeros(len(cls), bool)
            for c in ("title", "bare"):
                tc, to = vec.codepoints(b.column(c))
                alpha = t["alpha"](tc)
                k = np.zeros(len(tc) + 1, np.int64)
                np.cumsum(alpha, out=k[1:])
                h = vec.span_hash(vec.prefix(t["lower"](tc[alpha])), k[to[:-1]], k[to[1:]])
                own |= (ln["hash"] == h[ln["doc"]]) & (ln["letters"] > 0)
            form = np.zeros(len(cls), np.int32)
            form[ln["stop"] | (ln["letters"] > 160)] = _SENTENCE
            form[ln["cells"] > 0] = _ROW
            form[ln["heading"] | ln["item"] | ln["rule"] | ln["ask"] | (own & (ln["crumbs"] == 0)) | (ln["letters"] == 0)] = _ARTICLE_FORM
            form[(ln["cut"] & ~ln["heading"] & ~ln["item"]) | ((ln["crumbs"] > 1) & ~ln["stop"] & ~ln["heading"]) | ln["arrow"]] = _FRAME_FORM
            at = pa.array(ln["doc"])
            # lines of one list, and rows of as many cells, are a block, named by its first line
            kind = np.where(ln["item"], 1, np.where((ln["cells"] > 0) & ~ln["heading"], 2, 0))
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0) | ((kind[1:] == 2) & (ln["cells"][1:] != ln["cells"][:-1])) | (ln["no"][1:] != ln["no"][:-1] + 1) | (ln["doc"][1:] != ln["doc"][:-1])
            block = ln["no"][new][np.cumsum(new) - 1]
            yield batch(
                id=b.column("id").take(at), session=b.column("session").take(at), hk=b.column("hk").take(at), line_no=pa.array(ln["no"].astype(np.int32)), block=pa.array(block.astype(np.int32)), lh=i64(ln["hash"]), cls=pa.array(cls.astype(np.int32)),
                margin=pa.array((s[:, ARTICLE] - np.maximum(s[:, FRAME], s[:, RESIDUE])).astype(np.float32)), form=pa.array(form), own=pa.array(own & ~ln["heading"]),
            )

    return make


def classified(pages: DataFrame, model: dict) -> DataFrame:
    """Every line of every page with its class, form and the hash of its letters."""
    rows = pages.where("id is not null and text is not null and text <> ''").select(
        F.col("id").cast("long").alias("id"), F.coalesce("session", F.lit("")).alias("session"), F.xxhash64("host").alias("hk"), "text", F.coalesce("title", F.lit("")).alias("title"), bare_title().alias("bare"), title_kind().alias("kind")
    )
    return rows.mapInArrow(_line_maker(model["weights"]), LINES)


def frame_lines(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(id, session, line_no) of the lines that belong to the frame, in rows that hold an article."""
    lines = written(classified(pages, fit(pages) if model is None else model), "lines")
    per_host = lines.select("hk", "id").distinct().groupBy("hk").agg(F.count("*").alias("pages"))
    seen = lines.where(F.col("form") != _ARTICLE_FORM).select("hk", "lh", "id").distinct().groupBy("hk", "lh").agg(F.count("*").alias("n")).where(F.col("n") >= HOST_LEAST)
    often = written(seen.join(per_host, "hk").where(F.col("n") >= HOST_SHARE * F.col("pages")).select("hk", "lh", F.lit(True).alias("often")), "often")
    x = bounded_join(lines, often, ["hk", "lh"], "left").withColumn("often", F.coalesce("often", F.lit(False)))
    article = F.col("cls") == ARTICLE
    frame = (
        F.when(F.col("form") == _ARTICLE_FORM, False)
        .when(F.col("form") == _FRAME_FORM, True)
        .when(F.col("often"), ~(article & (F.col("margin") > 1.0)))
        .when(F.col("form").isin(_SENTENCE, _ROW), F.col("cls") == FRAME)
        .otherwise(True)
    )
    x = x.select("id", "session", "block", "line_no", frame.alias("frame"), (frame & F.col("often")).alias("sure"), (~frame & article & F.col("form").isin(_SENTENCE, _ROW)).alias("body"))
    # a set of line numbers is bounded by the page, however often its row is repeated
    x = x.groupBy("id", "session", "block").agg(F.max("body").alias("body"), (2 * F.count_if("frame") > F.count("*")).alias("frame"), F.collect_set("line_no").alias("lines"), F.collect_set(F.when(F.col("sure"), F.col("line_no"))).alias("sure"))
    whole = x.groupBy("id", "session").agg(F.max("body").alias("body"), F.flatten(F.collect_list(F.when(F.col("frame"), F.col("lines")).otherwise(F.col("sure")))).alias("frame"))
    return whole.where("body").select("id", F.when(F.col("session") != "", F.col("session")).alias("session"), F.explode("frame").alias("line_no"))


def blocks(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """The pages with main, the article's blocks alone, in order and laid out. Other columns stay."""
    model = fit(pages) if model is None else model
    cut = frame_lines(pages, model).groupBy(F.col("id").alias("__irspark_id"), F.coalesce("session", F.lit("")).alias("__irspark_session")).agg(F.collect_set("line_no").alias("__irspark_cut"))
    joined = pages.join(cut, (F.col("id") == F.col("__irspark_id")) & (F.coalesce("session", F.lit("")) == F.col("__irspark_session")), "left")

    @F.pandas_udf("string")
    def render(text: pd.Series, hidden: pd.Series) -> pd.Series:
        return pd.Series([main_body(t, h) for t, h in zip(text, hidden)], dtype=object)

    return joined.withColumn("main", render("text", "__irspark_cut")).drop("__irspark_id", "__irspark_session", "__irspark_cut")


def _page_maker(weights: np.ndarray, field_weights: np.ndarray):
    make = _line_maker(weights)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.slices(batches, "text"):
            row = pa.array(np.arange(b.num_rows))
            inner = b.set_column(b.schema.get_field_index("id"), "id", row)
            body, residue = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for x in make(iter([inner])):
                i, cls, form, margin = (x.column(c).to_numpy() for c in ("id", "cls", "form", "margin"))
                good = ((cls == ARTICLE) & ((form == _SENTENCE) | (form == _ROW) | (margin > 1.0))) & (form != _FRAME_FORM)
                body += np.bincount(i, good, b.num_rows)
                residue += np.bincount(i, cls == RESIDUE, b.num_rows)
            yield batch(id=b.column("id"), session=b.column("session"), field=pa.array(_has_field(b.column("text"), *vec.codepoints(b.column("text")), field_weights)), body=pa.array(body.astype(np.int64)), residue=pa.array(residue.astype(np.int64)))

    return pages


def residue(pages: DataFrame, model: dict | None = None, fields: dict | None = None) -> DataFrame:
    """(id, session, field, body, residue): whether a page holds an unfilled field, and how many lines are article and residue."""
    model, fields = fit(pages) if model is None else model, fit_fields(pages) if fields is None else fields
    rows = pages.where("id is not null and text is not null and text <> ''").select(
        F.col("id").cast("long").alias("id"), "session", F.xxhash64("host").alias("hk"), "text", F.coalesce("title", F.lit("")).alias("title"), bare_title().alias("bare"), title_kind().alias("kind")
    )
    return rows.mapInArrow(_page_maker(model["weights"], fields["weights"]), "id long, session string, field boolean, body long, residue long")


def found_residue(pages: DataFrame) -> DataFrame:
    """(id, session) of the pages to leave out: with an unfilled field, or with text but no article line."""
    return residue(pages).where("field or body = 0").select("id", "session").distinct()
