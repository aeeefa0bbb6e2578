"""Evaluation texts in training texts, by template canonicalisation.

Words of both sides are folded (compatibility forms, diacritics, case, punctuation aside); numbers, names and units become typed
placeholders; windows of WINDOW canonical words are hash-joined. Hits of one text and item are gathered on a band of
diagonals, and where they cover enough of the item the stretch is checked: which of the item's words stand in it in order, whether
the placeholders hold the item's own values (a copy), and else what stands in their place. The placeholders of aligned windows give a map from the item's
values to those of the stretch. It is consistent if a value always becomes the same one, two values never become one, none becomes
another value of the item, and some value is replaced in two places, without which nothing would tell the item's question from any
text of its template. A stretch with nearly all of the template and a consistent map is the question with other parameters.

The items are the stated query set: they go to all executors in blocks of at most BLOCK_WORDS words, each block against all texts. Which
words are names, and which of these are too common to tell items apart, is learned from all items first, so blocks change nothing.
A pair of text and item whose windows meet in more than PAIR_HITS places (both repeat the same words) isn't searched for
diagonals: all stretches of the text, one after the other, are checked.

Defined results: null ids are left out; null and empty texts and items hold nothing; items of fewer words than WINDOW are found only
as a whole; repeated rows change nothing, as results are distinct; the label of an item isn't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import batch

WINDOW = 5
BLOCK_WORDS = 400_000
#: Places at which a text and an item may meet to be searched for diagonals.
PAIR_HITS = 100_000
#: Share of an item's canonical words that a stretch with other values must have.
TEMPLATE_SHARE = 0.9
#: Share of an item's words that must stand in one stretch.
MIN_SHARE = 0.5
#: Accepted (share of words, share of placeholders of the part found with the item's own value): the more of the wording, the fewer values.
#: Texts of one template agree in up to two thirds of a short item's words, but in few of its values.
ACCEPTED = ((MIN_SHARE, 0.5), (0.65, 0.2), (0.75, 0.0))
#: Shares of an item's windows for the check: hits that hold a number or name and agree in all of them together with hits of any
#: kind, or hits of any kind alone (other parameters throughout).
MIN_SLOTS, MIN_HITS, MIN_TEMPLATE = 0.06, 0.12, 0.35
#: Letters of a capitalised word that is taken for a name.
NAME_LETTERS = 6
#: A name in more than this share of the items is an ordinary word for the check of values.
COMMON_NAME = 0.02

# Units that become a placeholder, after folding.
UNITS = ("mg", "g", "kg", "ml", "l", "cm", "mm", "毫克", "ngay", "phut", "lan", "days", "minutes", "times", "jours", "minutes", "fois")

NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 12, 13))


def _unit_hashes() -> np.ndarray:
    cp, off = vec.codepoints(pa.array([u for u in UNITS if not vec.is_single(u[0])], pa.large_string()))
    return np.unique(vec.words_of(cp, off, fold=True)["hash"])


def canonical(cp: np.ndarray, off: np.ndarray, names: np.ndarray, units: np.ndarray) -> dict[str, np.ndarray]:
    """Words with their canonical hash and slot type (0 none, 1 number, 2 name, 3 unit)."""
    t = vec.tables()
    w = vec.words_of(cp, off, fold=True)
    h, s, e = w["hash"], w["start"], w["end"]
    if not len(h):
        return w | {"canon": h, "slot": np.zeros(0, np.uint8), "caps": np.zeros(0, bool)}
    digits = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(t["digit"](cp), out=digits[1:])
    number = digits[e] - digits[s] == e - s
    folded = t["fold"](cp)
    latin = np.zeros(len(cp) + 1, np.int64)
    np.cumsum((folded >= 97) & (folded <= 122), out=latin[1:])
    upper = t["upper"](cp)
    caps = (w["len"] >= NAME_LETTERS) & upper[s] & ~upper[np.minimum(s + 1, len(cp) - 1)] & (latin[e] - latin[s] >= w["len"])
    name = caps | _isin(h, names)
    unit = _isin(h, units)
    slot = np.where(number, 1, np.where(name, 2, np.where(unit, 3, 0))).astype(np.uint8)
    canon = np.where(slot == 1, NUMBER, np.where(slot == 2, NAME, np.where(slot == 3, UNIT, h)))
    return w | {"canon": vec.mix(canon), "slot": slot, "caps": caps}


def _isin(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(x):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def _order(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Order by several keys of whole numbers from 0, as one number where they fit."""
    size = [int(k.max()) + 1 for k in keys]
    if np.prod(np.array(size, float)) >= 2.0**62:
        return np.lexsort(keys[::-1])
    x = np.zeros(len(keys[0]), np.int64)
    for k, n in zip(keys, size):
        x = x * n + k
    return np.argsort(x, kind="stable")


class Index:
    """Windows of a block of items, sorted by hash, with a bit filter in front. names: hashes of the names of all items, with those that are too common."""

    def __init__(self, ids: np.ndarray, texts: list[str], names: tuple[np.ndarray, np.ndarray]):
        self.ids = ids
        self.units = _unit_hashes()
        self.names, common = names
        cp, off = vec.codepoints(pa.array(texts, pa.large_string()))
        w = canonical(cp, off, self.names, self.units)
        self.hash, self.slot, self.doc, self.canon = w["hash"], w["slot"], w["doc"], w["canon"]
        # a capitalised word that many items have says as little as any other
        self.own = (self.slot == 1) | ((self.slot == 2) & ~_isin(self.hash, common))
        self.at = np.searchsorted(w["doc"], np.arange(len(texts) + 1))  # words of item i: at[i]..at[i+1]
        h, d = vec.shingles(w["canon"], w["doc"], WINDOW)
        pos = self._positions(w["doc"])
        order = np.lexsort((pos, d, h))
        self.win, self.item, self.pos = h[order], d[order], pos[order]
        self.windows = np.maximum(np.bincount(self.item, minlength=len(texts)), 1)
        # a window and an item, with the places that the item has it at
        new = np.append(True, (self.win[1:] != self.win[:-1]) | (self.item[1:] != self.item[:-1]))[: len(order)]
        self.first = np.flatnonzero(new)
        self.places = np.diff(np.append(self.first, len(order)))
        self.key = self.win[self.first]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.key >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _positions(doc: np.ndarray) -> np.ndarray:
        """Places of the windows in the order in which vec.shingles gives them."""
        n = len(doc)
        first = np.searchsorted(doc, doc)
        local = np.arange(n) - first
        full = local[: max(n - WINDOW + 1, 0)][doc[: max(n - WINDOW + 1, 0)] == doc[WINDOW - 1 :]] if n >= WINDOW else local[:0]
        size = np.bincount(doc) if n else np.zeros(0, int)
        return np.concatenate([full, np.zeros(int(((size < WINDOW) & (size > 0)).sum()), np.int64)]).astype(np.int64)

    def same_slots(self, words: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which hits hold a number or name and have the item's own value in every one of them."""
        i, j = at, self.at[item] + pos
        n = np.zeros(len(i), np.int8)
        same = np.ones(len(i), bool)
        for k in range(WINDOW):
            x, y = np.minimum(i + k, len(words) - 1), np.minimum(j + k, len(self.hash) - 1)
            slot = self.own[y]
            n += slot
            same &= ~slot | (words[x] == self.hash[y])
        return same & (n > 0)

    def hits(self, h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(text, place, item, place in item) of every common window, and the pairs (text, item) that have too many."""
        may = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        h, doc, pos = h[may], doc[may], pos[may]
        a, b = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        k, i = _spread(a, b - a)
        doc, pos, n = doc[k], pos[k], self.places[i]
        item = self.item[self.first[i]]
        pair, inv = np.unique(doc * (len(self.at) - 1) + item, return_inverse=True)
        many = np.bincount(inv, n, len(pair)) > PAIR_HITS if len(pair) else np.zeros(0, bool)
        few = ~many[inv]
        doc, pos, item, i = doc[few], pos[few], item[few], i[few]
        k, j = _spread(self.first[i], self.places[i])
        pair = pair[many]
        return (doc[k], pos[k], item[k], self.pos[j]), np.stack([pair // max(1, len(self.at) - 1), pair % max(1, len(self.at) - 1)], axis=1)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n numbers from first on: the run and the number of every element."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]


def _in_order(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, one bit per word of the item."""
    where: dict[int, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in text:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _runs(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words of the item belong to a run of three that stands in the text as well."""
    out = np.zeros(len(item), bool)
    if len(item) < 3:
        return np.full(len(item), _in_order(item.tolist(), text.tolist()) == len(item))
    key = lambda x: (x[:-2] * np.uint64(3)) ^ (x[1:-1] * np.uint64(5)) ^ (x[2:] * np.uint64(7)) if len(x) >= 3 else x[:0]
    hit = np.isin(key(item), key(text))
    for j in range(3):
        out[j : j + len(hit)] |= hit
    return out


def _consistent(place: np.ndarray, old: np.ndarray, new: np.ndarray, own: np.ndarray) -> tuple[int, bool]:
    """How many values of an item are replaced in aligned places, and whether that is consistent, which at least one value that is replaced
    in two places must show. own: all values of the item."""
    three = np.unique(np.stack([place.astype(np.uint64), old, new]), axis=1)
    pairs, times = np.unique(three[1:], axis=1, return_counts=True)
    changed = pairs[0] != pairs[1]
    one = len(np.unique(pairs[0])) == pairs.shape[1] == len(np.unique(pairs[1]))
    shown = bool((times[changed] > 1).any()) and one and not np.isin(pairs[1][changed], own).any()
    return int(changed.sum()), bool(shown)


class _Checker:
    """Checks stretches of the texts of a slice."""

    def __init__(self, index: Index, w: dict[str, np.ndarray], starts: np.ndarray):
        self.index, self.w, self.starts = index, w, starts

    def __call__(self, doc: int, item: int, lo: int, hi: int, q: np.ndarray, diag: np.ndarray) -> tuple | None:
        """The stretch of a text from diagonal lo to hi, with the hits (place in item, diagonal) that led to it."""
        index = self.index
        at = slice(index.at[item], index.at[item + 1])
        words, m = index.hash[at], index.at[item + 1] - index.at[item]
        slack = m // 8 + 4
        a = self.starts[doc] + max(0, lo - slack)
        e = min(self.starts[doc + 1], self.starts[doc] + hi + m + slack)
        text = self.w["hash"][a:e]
        run = _runs(words, text)
        share = run.sum() / m
        if share < MIN_SHARE / 2:
            return None
        common = _in_order(words.tolist(), text.tolist()) / m
        # only the part of the item that stands there is compared: from its first to its last run on the band
        hit = np.zeros(m, bool)
        for j in range(WINDOW):
            hit[np.minimum(q + j, m - 1)] = True
        part = np.flatnonzero(run & hit)
        part = slice(part[0], part[-1] + 1) if len(part) else slice(0, m)
        slots = index.own[at][part]
        template = min(_runs(index.canon[at], self.w["canon"][a:e]).sum(), _in_order(index.canon[at].tolist(), self.w["canon"][a:e].tolist())) / m
        # aligned placeholders: the first window that covers a word of the item
        i = np.minimum(q[:, None] + np.arange(WINDOW), m - 1).ravel()
        j = np.minimum(self.starts[doc] + (q + diag)[:, None] + np.arange(WINDOW), len(self.w["hash"]) - 1).ravel()
        kind = index.slot[at][i]
        ok = ((kind == 1) | (kind == 2)) & (self.w["slot"][j] == kind)
        replaced, consistent = _consistent(i[ok], words[i[ok]], self.w["hash"][j[ok]], words[(index.slot[at] == 1) | (index.slot[at] == 2)])
        return share, common, int(slots.sum()), int((slots & run[part]).sum()), template, replaced, consistent


def _searcher(index: Index):
    size, windows = np.diff(index.at), index.windows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.slices(batches, "text"):
            cp, off = vec.codepoints(b.column("text"))
            w = canonical(cp, off, index.names, index.units)
            if not len(w["hash"]):
                continue
            starts = np.searchsorted(w["doc"], np.arange(b.num_rows + 1))
            check = _Checker(index, w, starts)
            h, d = vec.shingles(w["canon"], w["doc"], WINDOW)
            (d, p, it, q), many = index.hits(h, d, Index._positions(w["doc"]))
            rows: dict[tuple, None] = {}  # every stretch, as the one with most words need not be the one with the item's values
            none = np.zeros(0, np.int64)
            for doc, item in many.tolist():
                step = max(1, int(size[item]) // 2)
                for lo in range(0, max(1, int(starts[doc + 1] - starts[doc]) - step), step):
                    if got := check(doc, item, lo, lo + step, none, none):
                        rows[(doc, item, *got)] = None
            for k in _bands(index, w, starts, d, p, it, q):
                if got := check(*k):
                    rows[(k[0], k[1], *got)] = None
            if rows:
                v = list(zip(*rows))
                number = lambda x: pa.array(x, pa.int64())
                yield batch(
                    item_id=number([int(index.ids[i]) for i in v[1]]), doc_id=b.column("doc_id").take(pa.array(v[0])), share=pa.array([round(float(x), 4) for x in v[2]]), in_order=pa.array([round(float(x), 4) for x in v[3]]),
                    slots=number(v[4]), slots_same=number(v[5]), template=pa.array([round(float(x), 4) for x in v[6]]), replaced=number(v[7]), consistent=pa.array(v[8], pa.bool_()),
                )

    def _bands(index, w, starts, d, p, it, q) -> Iterator[tuple]:
        """Bands of diagonals with enough hits: (text, item, lowest and highest diagonal, places in the item, diagonals)."""
        if not len(d):
            return
        own = index.same_slots(w["hash"], starts[d] + p, it, q)
        # pairs that can't reach the bounds on any band are dropped by counting
        pair = d * len(size) + it
        n_pair, own_pair = np.bincount(pair), np.bincount(pair[own], minlength=int(pair.max()) + 1)
        seen = np.flatnonzero(n_pair)
        k = windows[seen % len(size)]
        good = np.zeros(len(n_pair), bool)
        good[seen] = (n_pair[seen] >= MIN_TEMPLATE * k) | ((own_pair[seen] >= MIN_SLOTS * k) & (n_pair[seen] >= MIN_HITS * k))
        some = np.flatnonzero(good[pair])
        d, p, it, q, own = d[some], p[some], it[some], q[some], own[some]
        if not len(d):
            return
        # each hit in two bands
        width = np.maximum(size[it] // 4, 8)
        band = np.floor_divide(p - q, width)
        d, it, q, diag, band, own = np.tile(d, 2), np.tile(it, 2), np.tile(q, 2), np.tile(p - q, 2), np.concatenate([band, band + 1]), np.tile(own, 2)
        order = _order((d, it, band - band.min(), q, ~own))
        d, it, q, diag, band, own = d[order], it[order], q[order], diag[order], band[order], own[order]
        new = np.append(True, (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (band[1:] != band[:-1]))
        g = np.flatnonzero(new)
        fresh = new | np.append(True, q[1:] != q[:-1])  # places of the item count once
        n, n_own = np.add.reduceat(fresh.astype(np.int64), g), np.add.reduceat((fresh & own).astype(np.int64), g)
        lo, hi = np.minimum.reduceat(diag, g), np.maximum.reduceat(diag, g)
        k = windows[it[g]]
        ends = np.append(g[1:], len(d))
        for k in np.flatnonzero((n >= MIN_TEMPLATE * k) | ((n_own >= MIN_SLOTS * k) & (n >= MIN_HITS * k))):
            at = g[k] + np.flatnonzero(fresh[g[k] : ends[k]])
            yield int(d[g[k]]), int(it[g[k]]), int(lo[k]), int(hi[k]), q[at], diag[at]

    return search


def _namer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, item, caps) of the words of items, caps for those that stand somewhere with a capital like a name."""
    units = _unit_hashes()
    for b in vec.slices(batches, "text"):
        w = canonical(*vec.codepoints(b.column("text")), np.zeros(0, np.uint64), units)
        if len(w["hash"]):
            yield batch(h=pa.array(w["hash"].view(np.int64)), item=b.column("item_id").take(pa.array(w["doc"])), caps=pa.array(w["caps"]))


def names_of(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the names that items hold, and of those that more than COMMON_NAME of them hold; there are fewer than words of items."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    per = rows.mapInArrow(_namer, "h long, item long, caps boolean").groupBy("h").agg(F.max("caps").alias("caps"), F.count_distinct("item").alias("n")).where("caps")
    names, n = per.select("h", "n").toPandas(), rows.count()
    h = names["h"].to_numpy(np.int64).view(np.uint64)
    return np.sort(h), np.sort(h[names["n"].to_numpy() > max(2, COMMON_NAME * n)])


OUT = "item_id long, doc_id long, share double, in_order double, slots long, slots_same long, template double, replaced long, consistent boolean"


def _blocks(items: DataFrame) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, texts, words = [], [], 0
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for r in rows.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        words += len(r["text"]) // 2
        if words >= BLOCK_WORDS:
            yield np.array(ids, np.int64), texts
            ids, texts, words = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def matches(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Stretches of documents that share wording with an item: share of its words in common runs, share in order, and how many of the
    placeholders in the part that stands there hold its own values, share of its canonical words, how many values are replaced and whether consistently."""
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = names_of(items)
    parts = [docs.mapInArrow(_searcher(Index(ids, texts, names)), OUT) for ids, texts in _blocks(items)]
    return reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], OUT)


def found(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id): the document holds at least half of the item's wording in one stretch and in order, or nearly all of its template with values that are replaced consistently."""
    share = F.least("in_order", "share")
    ok = reduce(Column.__or__, [(share >= x) & (F.col("slots_same") >= y * F.col("slots")) for x, y in ACCEPTED])
    ok = ok | ((F.col("template") >= TEMPLATE_SHARE) & F.col("consistent"))
    return matches(items, documents).where(ok).select("item_id", "doc_id").distinct()
