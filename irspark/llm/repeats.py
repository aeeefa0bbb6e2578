"""Text repeated across one source's documents, found by content-defined chunks.

The letters of a text (lower case, everything else dropped) are cut where a rolling hash over WINDOW letters
meets a condition, so cuts depend on nearby letters only and not on line breaks or offsets. Distinct documents are counted
per (source, chunk), over all chunks of the text. Chunks of at least min_rows documents are cut.

found() gives whole lines: a line is a candidate if every chunk whose two cuts were decided within it is repeated, a line too short for
such a chunk counting as one; candidates are then counted exactly by their letters. cleaned() cuts these lines, and from the other lines
every sentence of which at least half of the letters lie in repeated chunks, such as a notice that stands behind other text or is wrapped.

Defined results: rows with a null id or source are never cases; null and empty texts have no lines; lines that begin with
'#' and lines without letters are no cases; a repeated row counts as another row. Letters are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_join, count_up_to, discard, written
from . import vec
from .common import batch, i64, lists

WINDOW = 8
#: A cut comes after this many letters on average, a power of two.
MEAN_CHUNK = 32
MIN_ROWS = 12

#: Repeated chunks that are sent to all executors; beyond that they are joined.
SENT_CHUNKS = 1_000_000

LINES = "id long, hk long, line_no int, lh long, fresh boolean"


def line_letters(cp: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Lines that can be cases: text, number, place, hash of the letters, and the letters with the bounds of each line and text among them."""
    t = vec.tables()
    doc, no, start, end = vec.lines_of(cp, off)
    alpha = t["alpha"](cp)
    n_alpha = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(alpha, out=n_alpha[1:])
    a, b = n_alpha[start], n_alpha[end]
    head = np.zeros(len(start), bool)
    full = end > start
    head[full] = cp[start[full]] == ord("#")
    ok = (b > a) & ~head
    pre = vec.prefix(t["lower"](cp[alpha]))
    return {"doc": doc[ok], "no": no[ok], "start": start[ok], "end": end[ok], "a": a[ok], "b": b[ok], "pre": pre, "hash": vec.span_hash(pre, a[ok], b[ok]), "bounds": n_alpha[off]}


def _first(keys: np.ndarray) -> np.ndarray:
    """One of the places of each key."""
    at = np.argsort(keys)
    out = np.zeros(len(keys), bool)
    out[at[np.append(True, keys[at[1:]] != keys[at[:-1]])[: len(at)]]] = True
    return out


def _chunks(pre: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first letter, end) of the chunks between the cuts of each text; bounds are the texts' places among the letters."""
    roll = (pre[WINDOW:] - pre[:-WINDOW]) * vec.powers(len(pre))[1][: max(len(pre) - WINDOW, 0)]
    cut = np.flatnonzero(roll & np.uint64((MEAN_CHUNK - 1) << 40) == 0) + WINDOW  # a chunk ends before this letter
    text = np.searchsorted(bounds, cut - 1, "right")
    ok = (text == np.searchsorted(bounds, cut - WINDOW, "right")) if len(cut) else np.zeros(0, bool)  # a window in two texts decides nothing
    cut, text = cut[ok], text[ok]
    k = np.flatnonzero(text[1:] == text[:-1])
    a, e = cut[k], cut[k + 1]
    return vec.span_hash(pre, a, e) if len(a) else np.zeros(0, np.uint64), a, e


def _letter_bounds(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(vec.tables()["alpha"](cp), out=n[1:])
    return n[off]


def _line_chunks(ln: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(hash, line) of the chunks that say something about a line, in order of lines, and all chunks of the texts."""
    pre, a, e = ln["pre"], ln["a"], ln["b"]
    every = _chunks(pre, bounds)
    h, start, end = every
    i, j = np.searchsorted(start, a + WINDOW, "left"), np.searchsorted(end, e, "right")
    inner = np.maximum(j - i, 0)
    whole = inner == 0
    line = np.repeat(np.arange(len(a)), inner)
    k = np.arange(len(line)) - np.repeat(np.cumsum(inner) - inner, inner) + i[line]
    c_line, c_hash = np.concatenate([line, np.flatnonzero(whole)]), np.concatenate([h[k], ln["hash"][whole]])
    order = np.argsort(c_line)
    return c_hash[order], c_line[order], every


def chunk_key(h: np.ndarray, hk: np.ndarray) -> np.ndarray:
    """One number for a source and a chunk."""
    return vec.mix(h + hk.view(np.uint64) * vec.BASE)


def _sources(b: pa.RecordBatch) -> np.ndarray:
    return b.column("hk").to_numpy(zero_copy_only=False).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): in how many documents of a slice the chunks of its texts stand."""
    for b in vec.slices(batches, "text"):
        cp, off = vec.codepoints(b.column("text"))
        ln, hk = line_letters(cp, off), _sources(b)
        h, line, (every, start, _) = _line_chunks(ln, ln["bounds"])
        doc = np.concatenate([ln["doc"][line], np.searchsorted(ln["bounds"], start, "right") - 1])
        key = chunk_key(np.concatenate([h, every]), hk[doc])
        own = vec.mix(key + doc.astype(np.uint64) * vec.BASE)
        at = np.argsort(own)
        own = own[at]
        at = at[np.append(True, own[1:] != own[:-1])[: len(at)]]  # once for each document
        key, n = np.unique(key[at], return_counts=True)
        yield batch(key=i64(key), n=pa.array(n.astype(np.int64)))


def _liner(keys: np.ndarray | None):
    """Lines that can be cases: those all of whose chunks are among keys (sorted), or all lines with their chunks' keys."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.slices(batches, "text"):
            cp, off = vec.codepoints(b.column("text"))
            ln, hk = line_letters(cp, off), _sources(b)
            if not len(ln["doc"]):
                continue
            h, line, _ = _line_chunks(ln, ln["bounds"])
            key = chunk_key(h, hk[ln["doc"][line]])
            size = np.bincount(line, minlength=len(ln["doc"]))
            if keys is None:
                ok, more = np.arange(len(size)), {"least": i64(np.minimum.reduceat(key, np.cumsum(size) - size)), "keys": lists(i64(key), size)}
            else:
                ok, more = np.flatnonzero(np.bincount(line[_among(key, keys)], minlength=len(size)) == size), {}
            fresh = _first(vec.mix(ln["hash"][ok] + ln["doc"][ok].astype(np.uint64) * vec.BASE))  # lines of the same letters have the same chunks
            at = pa.array(ln["doc"][ok])
            yield batch(id=b.column("id").take(at), hk=b.column("hk").take(at), line_no=pa.array(ln["no"][ok].astype(np.int32)), lh=i64(ln["hash"][ok]), fresh=pa.array(fresh), **more)

    return lines


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _sentencer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every sentence of a line with each chunk that it has letters of, and how many."""
    stops = np.array([ord(c) for c in ".!?\u2026"], np.uint32)
    wide = np.array([0x3002, 0xFF01, 0xFF1F, 0xFF1B], np.uint32)
    for b in vec.slices(batches, "text"):
        cp, off = vec.codepoints(b.column("text"))
        if not len(cp):
            continue
        bounds = _letter_bounds(cp, off)
        n = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(vec.tables()["alpha"](cp), out=n[1:])
        doc, no, start, end = vec.lines_of(cp, off)
        nxt = np.append(cp[1:], 32)
        stop = np.flatnonzero(np.isin(cp, wide) | (np.isin(cp, stops) & np.isin(nxt, (32, 160, 9)))) + 1
        line = np.searchsorted(start, stop - 1, "right") - 1
        inside = stop < end[line]
        stop, line = stop[inside], line[inside]
        s, l = np.concatenate([start, stop]), np.concatenate([np.arange(len(start)), line])
        order = np.lexsort((s, l))
        s, l = s[order], l[order]
        e = np.append(s[1:], 0)
        last = np.append(l[1:] != l[:-1], True)
        e[last] = end[l[last]]
        head = np.zeros(len(start), bool)
        head[end > start] = cp[start[end > start]] == 35
        a, z = n[s], n[e]
        ok = (z > a) & ~head[l]
        s, e, l, a, z = s[ok], e[ok], l[ok], a[ok], z[ok]
        h, first, after = _chunks(vec.prefix(vec.tables()["lower"](cp[vec.tables()["alpha"](cp)])), bounds)
        i, j = np.searchsorted(after, a, "right"), np.searchsorted(first, z, "left")
        size = np.maximum(j - i, 0)
        at = np.repeat(np.arange(len(s)), size)
        k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + i[at]
        if not len(at):
            continue
        d = doc[l[at]]
        i32 = lambda x: pa.array(x.astype(np.int32))
        yield batch(
            id=b.column("id").take(pa.array(d)), line_no=i32(no[l[at]]), start=i32(s[at] - start[l[at]]), end=i32(e[at] - start[l[at]]), letters=i32(z[at] - a[at]),
            key=i64(chunk_key(h[k], _sources(b)[d])), common=i32(np.minimum(z[at], after[k]) - np.maximum(a[at], first[k])),
        )


def host_key(col: str = "host"):
    return F.xxhash64(col)


def _rows(corpus: DataFrame, id: str, text: str, host: str) -> DataFrame:
    return corpus.where(F.col(id).isNotNull() & F.col(host).isNotNull()).select(F.col(id).cast("long").alias("id"), host_key(host).alias("hk"), F.col(text).alias("text"))


def chunks(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(key) of the chunks that stand in at least min_rows documents of their source, written."""
    return written(rows.mapInArrow(_counter, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows).select("key"), "chunks")


def repeated(corpus: DataFrame, min_rows: int = MIN_ROWS, id: str = "id", text: str = "text", host: str = "host", sent: int = SENT_CHUNKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repeated lines as (hk, lh, n), candidate line occurrences as (id, hk, line_no, lh, fresh), repeated chunks as (key))."""
    rows = _rows(corpus, id, text, host)
    often = chunks(rows, min_rows)
    if count_up_to(often, sent) <= sent:
        keys = np.sort(often.toPandas()["key"].to_numpy(np.int64).view(np.uint64))
        cand = written(rows.mapInArrow(_liner(keys), LINES), "candidates")
    else:  # by the least chunk first, which leaves few lines whose other chunks are then looked up
        some = bounded_join(rows.mapInArrow(_liner(None), LINES + ", least long, keys array<long>"), often.withColumnRenamed("key", "least"), ["least"], "left_semi")
        some = written(some.drop("least").withColumn("row", F.monotonically_increasing_id()), "lines")
        known = bounded_join(some.select("row", F.size("keys").alias("size"), F.explode("keys").alias("key")), often, ["key"], "left_semi")
        all_ = written(known.groupBy("row", "size").count().where("count = size").select("row"), "whole")
        cand = written(bounded_join(some, all_, ["row"], "left_semi").drop("row", "keys"), "candidates")
        discard(some, all_)
    again = written(cand.where("fresh").groupBy("hk", "lh").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows), "again")
    return again, cand, often


def found(corpus: DataFrame, min_rows: int = MIN_ROWS, id: str = "id", text: str = "text", host: str = "host", sent: int = SENT_CHUNKS) -> DataFrame:
    """(id, line_no) of the lines whose letters stand in at least min_rows rows of their source."""
    again, cand, often = repeated(corpus, min_rows, id, text, host, sent)
    discard(often)
    return bounded_join(cand, again.select("hk", "lh"), ["hk", "lh"], "left_semi").select("id", "line_no").distinct()


def _emptier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose lines with letters among gone are empty."""
    for b in vec.slices(batches, "text"):
        ln = line_letters(*vec.codepoints(b.column("text")))
        gone, size = b.column("gone").flatten().to_numpy().view(np.uint64), b.column("gone").value_lengths().fill_null(0).to_numpy()
        own = lambda h, doc: vec.mix(h + vec.mix(doc.astype(np.uint64)))
        at = np.flatnonzero(_among(own(ln["hash"], ln["doc"]), np.sort(own(gone, np.repeat(np.arange(len(size)), size)))))
        text = b.column("text").to_pylist()
        first = np.flatnonzero(np.append(True, ln["doc"][at[1:]] != ln["doc"][at[:-1]])) if len(at) else at
        for i, e in zip(first, np.append(first[1:], len(at))):
            doc = ln["doc"][at[i]]
            lines = text[doc].split("\n")
            for no in ln["no"][at[i:e]]:
                lines[no] = ""
            text[doc] = "\n".join(lines)
        b = b.drop_columns(["gone"])
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(text, pa.string()))


def emptied(rows: DataFrame, again: DataFrame, cand: DataFrame) -> DataFrame:
    """rows, which have id, hk and text, with nothing left of their repeated lines but the line breaks. again and cand are repeated()'s."""
    # a row that has another's id and source gets lines that it may not have; those that it has are repeated lines in any case
    gone = written(bounded_join(cand, again.select("hk", "lh"), ["hk", "lh"], "left_semi").groupBy("id", "hk").agg(F.collect_set("lh").alias("gone")), "gone")
    joined = bounded_join(rows, gone, ["id", "hk"], "left").select(*rows.columns, "gone")
    return joined.mapInArrow(_emptier, rows.schema)


def cleaned(corpus: DataFrame, min_rows: int = MIN_ROWS, id: str = "id", text: str = "text", host: str = "host", sent: int = SENT_CHUNKS) -> DataFrame:
    """The corpus with repeated lines and sentences cut out of text, and n_cut, how many were cut. Other columns stay."""
    again, cand, often = repeated(corpus, min_rows, id, text, host, sent)
    whole = bounded_join(cand, again.select("hk", "lh"), ["hk", "lh"], "left_semi").select("id", "line_no", F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    part = bounded_join(_rows(corpus, id, text, host).mapInArrow(_sentencer, "id long, line_no int, start int, end int, letters int, key long, common int"), often, ["key"], "left_semi")
    # a repeated row gives its chunks again
    part = part.distinct().groupBy("id", "line_no", "start", "end", "letters").agg(F.sum("common").alias("c")).where("2 * c >= letters").select("id", "line_no", "start", "end")
    # a row's cuts are bounded by its text
    cut = whole.union(part).groupBy(F.col("id").alias("__irspark_id")).agg(F.sort_array(F.collect_set(F.struct("line_no", "start", "end")), asc=False).alias("__irspark_cut"))
    joined = corpus.join(cut, F.col(id) == F.col("__irspark_id"), "left")

    def rest(line: Column, i: Column) -> Column:
        own = F.filter("__irspark_cut", lambda c: c["line_no"] == i)
        left = F.aggregate(F.filter(own, lambda c: c["start"] >= 0), line, lambda acc, c: F.concat(F.substring(acc, F.lit(1), c["start"]), F.substring(acc, c["end"] + 1, F.length(acc))))
        return F.when(F.exists(own, lambda c: c["start"] < 0), None).when((F.size(own) > 0) & (F.trim(left) == ""), None).otherwise(F.when(F.size(own) > 0, F.rtrim(left)).otherwise(line))

    kept = F.filter(F.transform(F.split(text, "\n", -1), rest), lambda x: x.isNotNull())
    lines = F.size(F.filter("__irspark_cut", lambda c: c["start"] < 0))
    alone = F.filter("__irspark_cut", lambda c: (c["start"] >= 0) & ~F.exists("__irspark_cut", lambda o: (o["line_no"] == c["line_no"]) & (o["start"] < 0)))
    return joined.withColumn(text, F.when(F.col("__irspark_cut").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).withColumn("n_cut", F.coalesce(lines + F.size(alone), F.lit(0))).drop("__irspark_id", "__irspark_cut")
