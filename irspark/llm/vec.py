"""Vectorised text kernels: whole Arrow batches as one array of code points.

A batch of texts becomes one uint32 array; lines, words, rolling hashes and shingles are found by table look-ups
and prefix sums over it, with no Python loop over characters or rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
#: Code points handled at once; bounds the memory of a Python worker, whatever size Arrow batches have.
SLICE_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n at least."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, 1 << 20)
        for k, b in (("p", BASE), ("q", BASE_INV)):
            a = np.full(n, b, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE^i; span_hash takes the hash of any span from them."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    x = np.add(values, U64(1), dtype=U64, casting="unsafe")
    x *= p[: len(values)]
    np.cumsum(x, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end); equal spans have equal hashes wherever they stand."""
    _, q = powers(len(pre))
    return mix((pre[end] - pre[start]) * q[start] + (end - start).astype(U64))


class Table:
    """A function of characters as an array over the first plane; other planes are evaluated when met."""

    def __init__(self, fn, dtype):
        self.fn, self.dtype = fn, dtype
        self.low = np.fromiter((fn(chr(i)) for i in range(0x10000)), dtype, 0x10000)

    def __call__(self, cp: np.ndarray) -> np.ndarray:
        if not cp.size or cp.max() < 0x10000:
            return self.low[cp]
        out = self.low[np.minimum(cp, 0xFFFF)]
        at = np.flatnonzero(cp >= 0x10000)
        u, inv = np.unique(cp[at], return_inverse=True)
        out[at] = np.array([self.fn(chr(x)) for x in u], self.dtype)[inv]
        return out


def is_single(c: str) -> bool:
    """Characters that are words by themselves: Han and kana."""
    o = ord(c)
    return 0x3040 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xFF66 <= o <= 0xFF9D or 0x20000 <= o <= 0x3FFFF


def _lower(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 else ord(c)


def _fold(c: str) -> int:
    """Base letter of a character: compatibility form, without diacritics, in lower case; 0 if nothing is left."""
    if c in "đĐ":
        return ord("d")
    if 0x3040 <= ord(c) <= 0x30FF:
        return ord(c)
    s = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
    if not s:
        return 0
    low = s[0].casefold()
    return ord(low[0])


def _word(c: str) -> int:
    """0 separator, 1 part of a word, 2 a word by itself, 3 mark that belongs to the letter before it."""
    if is_single(c):
        return 2
    if c.isalnum():
        return 1
    return 3 if unicodedata.category(c) in ("Mn", "Mc", "Cf") else 0


@cache
def tables() -> dict[str, Table]:
    return {
        "alpha": Table(lambda c: c.isalpha(), bool), "lower": Table(_lower, np.uint32), "word": Table(_word, np.uint8),
        "fold": Table(_fold, np.uint32), "digit": Table(lambda c: c.isdigit(), bool), "upper": Table(lambda c: c.isupper(), bool),
    }


def codepoints(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the offsets of the texts. A null is an empty text."""
    a = a.cast(pa.large_string())
    n = len(a)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1] if n else np.zeros(1, np.int64)
    if n == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    if a.null_count:
        a = pa.array(["" if x is None else x for x in a.to_pylist()], pa.large_string())
        off = np.frombuffer(a.buffers()[1], np.int64)[: n + 1]
    raw = memoryview(a.buffers()[2])[off[0] : off[-1]]
    cp = np.frombuffer(str(raw, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.append(0, np.cumsum(pc.utf8_length(a).to_numpy()))


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has about chars bytes of text; one longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        a = b.column(column).cast(pa.large_string())
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + chars, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def lines_of(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, start, end) of every line; a text of no characters has one empty line."""
    nl = np.flatnonzero(cp == 10)
    start = np.concatenate([off[:-1], nl + 1])
    # a line break belongs to the text it stands in
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, nl, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    no = np.arange(len(doc)) - first[doc]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end = np.empty_like(start)
    end[~last] = start[1:][~last[:-1]] - 1
    end[last] = off[doc[last] + 1]
    return doc, no, start, end


def words_of(cp: np.ndarray, off: np.ndarray, fold: bool = False, keep: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Words in order: hash, text number, first and last code point.

    A Han or kana character is a word; other words are runs of letters and digits. fold: without regard to diacritics and
    compatibility forms. keep: mask of the code points that count.
    """
    t = tables()
    cls = t["word"](cp)
    if keep is not None:
        cls = cls * keep
    chars = None
    if fold:
        chars = t["fold"](cp)
        cls = np.where((chars == 0) & (cls == 1), 3, cls)
    marks = np.flatnonzero(cls == 3)  # they don't break a word
    if marks.size:
        solid = np.flatnonzero(cls != 3)
        r = np.flatnonzero(cls[solid])
        used = solid[r]
    else:
        r = used = np.flatnonzero(cls)
    if not used.size:
        z = np.zeros(0, np.int64)
        return {"hash": np.zeros(0, U64), "doc": z, "start": z, "end": z, "len": z}
    single = cls[used] == 2
    gap = np.ones(len(used), bool)
    gap[1:] = (r[1:] != r[:-1] + 1) | single[1:] | single[:-1]
    first = np.searchsorted(used, off[1:-1])
    gap[first[first < len(used)]] = True
    s = np.flatnonzero(gap)
    e = np.append(s[1:], len(used))
    vals = chars[used] if fold else t["lower"](cp[used])
    if not fold and marks.size:  # a decomposed letter is another word than the letter without its mark
        vals = vals.astype(np.int64)
        marks = marks[~np.isin(cp[marks], (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD))]
        at = np.searchsorted(used, marks) - 1
        ok = at >= 0
        np.add.at(vals, at[ok], cp[marks[ok]].astype(np.int64) << 21)
    d = np.searchsorted(off, used[s], "right") - 1
    return {"hash": span_hash(prefix(vals), s, e), "doc": d, "start": used[s], "end": used[e - 1] + 1, "len": e - s}


_MULT = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the k-word sequences; a text of fewer words has one, of all its words."""
    n = len(h)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(first, n))
    out_h, out_d = [], []
    if n >= k:
        acc = np.zeros(n - k + 1, U64)
        for j in range(k):
            acc = (acc + h[j : n - k + 1 + j]) * _MULT[j % 8]
        ok = doc[: n - k + 1] == doc[k - 1 :]
        out_h.append(mix(acc[ok]))
        out_d.append(doc[: n - k + 1][ok])
    short = size < k
    if short.any():
        pre = prefix(h)
        out_h.append(span_hash(pre, first[short], first[short] + size[short]))
        out_d.append(doc[first[short]])
    return np.concatenate(out_h), np.concatenate(out_d)
