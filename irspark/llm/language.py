"""Language of texts and of their stretches by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound as the product of its letters' vectors, each rotated by
its place: three letters of an alphabet, or one or two of the signs that are words by themselves (Han, kana), whose classes are by hash. A language's
prototype is the bundle (sum) of the n-grams of labelled sentences, each with the root of its count, less what all languages share; a sentence is compared
with the prototypes by cosine. An n-gram's products with all prototypes are kept once known, so a sentence costs one look-up per letter.
N-grams of words with a capital, of which many are names and of no language, count less (NAME_WEIGHT).
A sentence whose best cosine is lower than nearly all that the language's own labelled sentences have is in another language (OTHER).

Prototypes are fitted on a bounded sample of labelled rows (TRAIN_ROWS rows of at most TRAIN_CHARS characters) in rounds: sentences that one
round assigns to another language than their row's label are left out of the next.

Defined results: null and empty texts and texts without sentences have no stretch; rows with a null id are left out; a
repeated row gives repeated stretches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import batch

LANGS = ("en", "fr", "ja", "vi", "zh")
OTHER = "other"
TRAIN_ROWS, TRAIN_CHARS = 2000, 20_000
DIM = 2048
#: Letters of alphabets, and classes of signs that are words by themselves.
SYMBOLS, SIGNS = 128, 1024
CODES_ALL = SYMBOLS**3 + SIGNS**2 + SIGNS
#: Weight of an n-gram of a word that begins with a capital.
NAME_WEIGHT = 0.2
#: Share of a language's own sentences whose cosine is lower than what counts as that language.
STRANGE = 0.002
#: Cosine from which on a sentence isn't strange, however alike the labelled ones are.
SURE = 0.15
#: Letters a stretch needs to be a full sentence: of alphabetic scripts, of Han and kana.
MIN_ALPHABETIC, MIN_SINGLE = 18, 5
#: Least advantage of the best cosine over the second, relative to the best.
MIN_MARGIN = 0.05

# Spellings of the languages of the data in labels (two and three letters, ISO 639).
CODES = {"vi": "vi", "vie": "vi", "en": "en", "eng": "en", "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "fr": "fr", "fra": "fr", "fre": "fr", "ja": "ja", "jpn": "ja"}
# Letters with marks that have a symbol of their own.
MARKED = "àâäæçéèêëîïôöœùûüÿăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹáãìíòóõúýñ"


def named(label: Column) -> Column:
    """Language that a label names, whatever its case, region and script; null if it names none."""
    first = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    out = F.lit(None).cast("string")
    for k, v in CODES.items():
        out = F.when(first == k, v).otherwise(out)
    return out


def _symbol(c: str) -> int:
    """0 for everything that isn't a letter; else a class below SYMBOLS, or from there on for a sign."""
    c = unicodedata.normalize("NFKC", c)[:1] or c
    o, low = ord(c), c.lower()[:1]
    if "a" <= low <= "z":
        return ord(low) - 96
    if low and low in MARKED:
        return 27 + MARKED.index(low)
    if vec.is_single(c):
        return SYMBOLS + (o * 40503 & 0xFFFF) % SIGNS
    return 112 + o % 16 if c.isalpha() else 0


_cache: dict = {}


def _table() -> vec.Table:
    if "t" not in _cache:
        _cache["t"] = vec.Table(_symbol, np.int32)
    return _cache["t"]


def letter_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The rotations of the vectors of letters (three) and of signs (two); the separator has a vector too."""
    rng = np.random.default_rng(5)
    v, w = (rng.integers(0, 2, (n, DIM)).astype(np.int8) * 2 - 1 for n in (SYMBOLS, SIGNS))
    return np.stack([np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v]), np.stack([np.roll(w, 1, axis=1), w])


def bound(codes: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Vectors of n-grams."""
    out = np.empty((len(codes), DIM), np.int8)
    three = codes < SYMBOLS**3
    c, (v, w) = codes[three], vectors
    out[three] = v[0][c >> 14] * v[1][(c >> 7) & 127] * v[2][c & 127]
    c = codes[~three] - SYMBOLS**3
    out[~three] = w[1][c % SIGNS]
    two = np.flatnonzero(~three)[c < SIGNS**2]
    out[two] *= w[0][c[c < SIGNS**2] // SIGNS]
    return out


def sentences(cp: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Full sentences (text, start, end, ended) and the n-grams of their letters (code, sentence, weighted count) in order of sentences.

    A sentence ends with a stop that is followed by a space or a line end, with a Han stop, or with the line.
    """
    n = len(cp)
    doc_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    nxt = np.append(cp[1:], 10)
    if n:
        nxt[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)] - 1] = 10
    wide = np.isin(cp, (0x3002, 0xFF01, 0xFF1F, 0xFF0E))
    stop = wide | (np.isin(cp, (46, 33, 63)) & np.isin(nxt, (32, 10, 13, 160, 9)))
    brk = (cp == 10) | (cp == 13)
    close = stop | brk
    if n:
        close[off[1:][off[1:] > 0] - 1] = True
    end = np.flatnonzero(close) + 1
    start = np.append(0, end[:-1]).astype(np.int64) if len(end) else np.zeros(0, np.int64)
    sid = np.repeat(np.arange(len(end)), end - start) if len(end) else np.zeros(n, np.int64)
    sym = _table()(cp)
    letter, single = sym > 0, sym >= SYMBOLS
    a = np.bincount(sid[letter & ~single], minlength=len(end))
    s = np.bincount(sid[single], minlength=len(end))
    full = (stop[end - 1] if len(end) else np.zeros(0, bool)) & ((s >= MIN_SINGLE) | (a >= MIN_ALPHABETIC))
    w = vec.words_of(cp, off)
    caps = np.zeros(n + 1, np.int32)
    name = np.flatnonzero(vec.tables()["upper"](cp[w["start"]])) if len(w["start"]) else np.zeros(0, np.int64)
    np.add.at(caps, w["start"][name], 1)
    np.add.at(caps, w["end"][name], -1)
    weight = np.where(np.cumsum(caps[:-1]) > 0, NAME_WEIGHT, 1.0)
    # letters in order, runs of others as one separator; marks belong to the letter before them
    solid = np.flatnonzero((cp < 0x300) | (cp > 0x36F))
    letter, sid, sym, weight = letter[solid], sid[solid], sym[solid], weight[solid]
    use = letter | np.append(False, letter[:-1]) if len(solid) else letter
    x, xs, weight = sym[use], sid[use], weight[use]
    codes, at, wt = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(x) >= 2:
        alone = x >= SYMBOLS
        two = np.flatnonzero(alone[1:] & alone[:-1] & (xs[1:] == xs[:-1]) & full[xs[1:]])
        codes.append(SYMBOLS**3 + (x[two] - SYMBOLS).astype(np.int64) * SIGNS + (x[two + 1] - SYMBOLS))
        at.append(xs[two])
        wt.append(weight[two + 1])
        one = np.flatnonzero(alone & full[xs])
        codes.append(SYMBOLS**3 + SIGNS**2 + (x[one] - SYMBOLS).astype(np.int64))
        at.append(xs[one])
        wt.append(weight[one])
        y = np.where(alone, 0, x)
        some = (y[:-2] > 0) | (y[1:-1] > 0) | (y[2:] > 0)
        three = np.flatnonzero(some & (xs[:-2] == xs[2:]) & full[xs[:-2]])
        codes.append((y[three].astype(np.int64) << 14) | (y[three + 1] << 7) | y[three + 2])
        at.append(xs[three])
        wt.append(weight[three + 1])
    key, wt = np.concatenate(at) * CODES_ALL + np.concatenate(codes), np.concatenate(wt)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    count = np.add.reduceat(wt[order], first) if len(first) else wt
    code = key[first]
    return {"doc": doc_of[start] if len(start) else start, "start": start, "end": end, "full": full, "code": code % CODES_ALL, "sent": code // CODES_ALL, "count": count}


class Scorer:
    """Products of trigram vectors with the prototypes, filled as trigrams are met."""

    def __init__(self, prototypes: np.ndarray):
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        p = unit(prototypes)
        self.p = unit(p - p.mean(axis=0)).astype(np.float32).T  # what all languages share tells nothing
        self.table = np.zeros((CODES_ALL, prototypes.shape[0]), np.float32)
        self.known = np.zeros(CODES_ALL, bool)
        self.vectors = letter_vectors()

    def __call__(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sentence numbers, cosine of each with every prototype)."""
        code = s["code"]
        new = np.unique(code[~self.known[code]])
        for i in range(0, len(new), 2048):
            c = new[i : i + 2048]
            self.table[c] = bound(c, self.vectors).astype(np.float32) @ self.p
        self.known[new] = True
        if not len(code):
            return np.zeros(0, np.int64), np.zeros((0, self.p.shape[1]), np.float32)
        at = np.flatnonzero(np.append(True, s["sent"][1:] != s["sent"][:-1]))
        w = s["count"].astype(np.float32)
        total = np.add.reduceat(self.table[code] * w[:, None], at, axis=0)
        # n-gram vectors are nearly orthogonal: the square of a bundle's length is about DIM times that of its counts
        return s["sent"][at], total / np.sqrt(np.add.reduceat(w * w, at) * DIM)[:, None]


def train(documents: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Prototypes of LANGS from about rows labelled rows of at most chars characters, chosen by a hash of their id, and the least cosine of each language."""
    label = named(F.col("lang"))
    have = documents.where(label.isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= chars))
    total = have.count()
    if total > rows:
        have = have.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total))
    sample = have.select(label.alias("label"), "text").toPandas()
    lab = np.array([LANGS.index(x) for x in sample["label"]], np.int64)
    part, want, rows_before = [], [], 0
    texts = pa.RecordBatch.from_arrays([pa.array(sample["text"], pa.large_string())], ["text"])
    for piece in vec.slices(iter([texts]), "text"):
        s = sentences(*vec.codepoints(piece.column("text")))
        part.append((s["code"], s["sent"] + sum(map(len, want)), s["count"]))
        want.append(lab[s["doc"] + rows_before])
        rows_before += piece.num_rows
    none = np.zeros(0, np.int64)
    part.append((none, none, np.zeros(0)))
    s = dict(zip(("code", "sent", "count"), map(np.concatenate, zip(*part))))
    want = np.concatenate([none, *want])
    vectors = letter_vectors()
    prototypes, least = np.zeros((len(LANGS), DIM)), np.zeros(len(LANGS))
    keep = np.ones(len(want), bool)
    for _ in range(3):
        prototypes = np.zeros((len(LANGS), DIM))
        for k in range(len(LANGS)):
            pick = (want[s["sent"]] == k) & keep[s["sent"]]
            codes, inv = np.unique(s["code"][pick], return_inverse=True)
            n = np.bincount(inv, s["count"][pick], len(codes))
            for i in range(0, len(codes), 4096):
                prototypes[k] += np.sqrt(n[i : i + 4096]).astype(np.float32) @ bound(codes[i : i + 4096], vectors).astype(np.float32)
        sent, cos = Scorer(prototypes)(s)
        right = cos.argmax(axis=1) == want[sent] if len(sent) else np.zeros(0, bool)
        keep = np.zeros(len(want), bool)
        keep[sent] = right
        own = [cos[right & (want[sent] == k), k] for k in range(len(LANGS))]
        least = np.array([min(SURE, np.quantile(x, STRANGE)) if len(x) else 0.0 for x in own])
    return prototypes, least


def _segmenter(prototypes: np.ndarray, least: np.ndarray, merge: bool):
    names = np.array([*LANGS, OTHER])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(prototypes)
        for b in vec.slices(batches, "text"):
            cp, off = vec.codepoints(b.column("text"))
            s = sentences(cp, off)
            sent, cos = score(s)
            if not len(sent):
                continue
            best = cos.argmax(axis=1)
            two = np.partition(cos, -2, axis=1)
            top = two[:, -1]
            conf = np.clip((top - two[:, -2]) / np.maximum(top, 1e-6), 0, 1)
            strange = top < least[best]
            conf = np.where(strange, np.clip(1 - top / np.maximum(least[best], 1e-6), 0, 1), conf)
            best = np.where(strange, len(LANGS), best)
            doc = s["doc"][sent]
            if merge:  # neighbours of one language are one stretch
                new = np.append(True, (doc[1:] != doc[:-1]) | (best[1:] != best[:-1]))
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(sent)))
                start, end = s["start"][sent[at]], s["end"][sent[np.append(at[1:], len(sent)) - 1]]
                doc, best, conf = doc[at], best[at], np.add.reduceat(conf, at) / n
            else:
                sure = (conf >= MIN_MARGIN) & ~strange
                key = np.unique(doc[sure] * len(LANGS) + best[sure])
                doc, best = key // len(LANGS), key % len(LANGS)
                start = end = n = conf = np.zeros(len(doc))
            i64 = pa.int64()
            d = pa.array(doc)
            yield batch(
                doc_id=b.column("doc_id").take(d), label=b.column("label").take(d), lang=pa.array(names[best], pa.string()), sentences=pa.array(np.asarray(n, np.int64)),
                char_start=pa.array((start - (off[doc] if merge else 0)).astype(np.int64), i64), char_end=pa.array((end - (off[doc] if merge else 0)).astype(np.int64), i64), confidence=pa.array(np.round(np.asarray(conf, np.float64), 4)),
            )

    return segment


_OUT = "doc_id long, label string, lang string, sentences long, char_start long, char_end long, confidence double"


def stretches(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, merge: bool = True) -> DataFrame:
    """Per text and stretch in one language: its language (or OTHER), place and confidence; label is the language its row names.

    merge=False gives one row per text and language with a full sentence that is told apart by MIN_MARGIN at least.
    """
    prototypes, least = train(documents) if model is None else model
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), named(F.col("lang")).alias("label"), "text")
    return rows.mapInArrow(_segmenter(prototypes, least, merge), _OUT)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, lang) of the languages with a full sentence that the row's label doesn't name."""
    return stretches(documents, merge=False).where("label is null or label <> lang").select("doc_id", "lang").distinct()
