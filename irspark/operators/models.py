"""Work that needs a model: encoding units, scoring pairs, fetching and extracting pages. Models are interfaces, made once per worker;
each comes with a deterministic implementation that needs nothing from outside."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, siterules
from ..functions import text as T
from ..functions.kernels import unit_words
from . import runs
from .chunking import pending
from .hosts import Control, Limiter, step, told_to_wait


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Fetcher(Protocol):
    def __call__(self, url: str) -> tuple[str, str | None]: ...


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """Unit vectors of signed hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in unit_words(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return lambda: encode


def overlap_scorer() -> Scorer:
    """Share of the query's words that the text has."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            want = set(unit_words(q))
            out.append(len(want & set(unit_words(t))) / max(1, len(want)))
        return out

    return score


def encode(units: DataFrame, done: DataFrame | None, load: Callable[[], Encoder], batch: int = 256) -> DataFrame:
    """(unit_id, h, v) of the units (unit_id, h, ctx, text) that done doesn't hold; texts of like length go together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            b = b.iloc[b["t"].str.len().argsort(kind="stable")[::-1]]
            for i in range(0, len(b), batch):
                x = b.iloc[i : i + batch]
                yield pd.DataFrame({"unit_id": x["unit_id"], "h": x["h"], "v": list(np.asarray(model(x["t"].tolist()), np.float32))})

    todo = units if done is None else pending(units, done)
    return todo.where("text is not null").select("unit_id", "h", T.unit_input(F.col("ctx"), F.col("text")).alias("t")).mapInPandas(run, "unit_id string, h string, v array<float>")


def rerank(run: DataFrame, units: DataFrame, queries: DataFrame, load: Callable[[], Scorer], top_n: int = 400, base: str = "vi") -> DataFrame:
    """(qid, unit_id, doc_id, rank, score): the top of a run by a scorer of (query, text), then its tail.

    run (qid, unit_id, doc_id, rank); units (unit_id, lang, ctx, text); queries (qid, lang, query). The query in the unit's language is
    used where there is one, else the base language's. Units without a text drop out of the top.
    """
    top = run.where(F.col("rank") <= top_n).join(units.select("unit_id", "lang", "ctx", "text"), "unit_id")
    own = queries.select("qid", "lang", F.col("query").alias("own"))
    other = queries.where(F.col("lang") == base).select("qid", F.col("query").alias("other"))
    x = top.join(own, ["qid", "lang"], "left").join(other, "qid", "left").select("qid", "unit_id", "doc_id", "rank", F.coalesce("own", "other", F.lit("")).alias("q"), T.unit_input(F.col("ctx"), F.col("text")).alias("t"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b[["qid", "unit_id", "doc_id", "rank"]].assign(score=np.round(np.asarray(model(list(zip(b["q"], b["t"]))), float), 6))

    scored = x.mapInPandas(score, "qid long, unit_id string, doc_id long, rank long, score double")
    best = runs.by_score(scored.withColumnRenamed("rank", "old"), group=("qid",), then=("old",)).drop("old")
    return runs.with_tail(best, run, top_n)


def fetch(links: DataFrame, load: Callable[[], Fetcher], tries: int = 3, wait: float = 0.0, rate: float | None = None, budget: float | None = None, clock=time.monotonic, sleep=time.sleep) -> DataFrame:
    """(id, url, host, status, html, attempts) of links; a fetcher gives (status, body) or (status, body, seconds to wait). Throttled answers are tried
    again after growing waits; an exception is a status like any other.

    With a rate (starts of requests a second and host) a host's links are fetched by one task, one after the other, under the host's
    control: its pauses and the waits that answers name are kept. A host that is given up, or names a wait of budget seconds or more, leaves
    its other links with status 'host_dead'.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, state, limiters = load(), {}, {}

        def once(u: str, host: str) -> tuple[str, str | None]:
            if rate is not None:
                c = state.setdefault(host, Control.start())
                if c.dead:
                    return "host_dead", None
                if clock() < c.pause_until:
                    sleep(c.pause_until - clock())
                limiters.setdefault(host, Limiter(rate, clock, sleep)).wait()
            try:
                status, body, *told = get(u)
            except Exception as e:  # noqa: BLE001
                status, body, told = f"err_{type(e).__name__.lower()}", None, ()
            if rate is not None:
                state[host] = told_to_wait(c, told[0], clock(), budget) if told and told[0] else step(c, T.outcome_of(status), clock())
            return status, body

        for b in batches:
            rows = []
            for i, u, host in zip(b["id"], b["url"], b["host"]):
                for n in range(1, tries + 1):
                    status, body = once(u, host)
                    if status == "host_dead" or not (status.startswith(("err_", "http_5")) or status == "http_429"):
                        break
                    sleep(wait * 2**n)
                rows.append((i, u, host, status, body, n))
            yield pd.DataFrame(rows, columns=["id", "url", "host", "status", "html", "attempts"])

    x = links.select("id", "url", T.host_of(F.col("url")).alias("host"))
    x = x if rate is None else x.repartition("host")
    return x.mapInPandas(run, "id long, url string, host string, status string, html string, attempts int")


def replay(pages: dict[str, tuple[str, str | None]]) -> Callable[[], Fetcher]:
    """Fetcher that answers from a table, as there is no network in tests."""
    return lambda: lambda url: pages.get(url, ("http_404", None))


def extract_pages(raw: DataFrame, xv: int, rules: list[siterules.SiteRule] = (), notice: str = "") -> DataFrame:
    """Records of stored pages (id, url, host, html) under extractor version xv: by the site's rule where it fits, else generally. Short
    pages that match notice are notices; a newer xv wins when attempts are merged, so this also re-extracts."""
    cols = ["title", "text", "description", "author", "published", "modified", "keywords", "site_name", "section", "status", "extractor"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, host, source in zip(b["url"], b["host"], b["html"]):
                x = html.extract(source, url, host) | {"extractor": "generic"}
                rule = siterules.find_rule(host or "", list(rules))
                if rule is not None and not x["status"].startswith("err"):
                    root = html.parse(source)
                    asked = siterules.question_lines(root, rule) if rule.question else None
                    lines = asked[0] if asked else siterules.site_lines(root, rule)
                    if lines is not None:
                        x |= {"text": "\n".join(lines), "status": "ok" if lines else "empty", "extractor": "rule"}
                        if rule.title:
                            x["title"] = next((html.clean_field(n.text(), 300) for n in siterules.select(root, rule.title)), x["title"])
                rows.append([x[c] for c in cols])
            yield pd.DataFrame(rows, columns=cols).fillna("").astype(str).assign(id=b["id"].to_numpy(), host=b["host"].to_numpy())[["id", "host", *cols]]

    out = raw.select("id", "url", "host", "html").mapInPandas(run, "id long, host string, " + ", ".join(f"{c} string" for c in cols))
    if notice:
        out = out.withColumn("status", F.when((F.col("status") == "ok") & T.is_notice(F.col("title"), F.col("text"), notice), "notice").otherwise(F.col("status")))
    return out.withColumns({"xv": F.lit(xv).cast("short"), "n_chars": F.length("text"), "text_hash": T.text_hash(T.to_plain(F.col("text"))), "lang": T.detect_lang(F.col("text"), F.col("host"), F.lit(""))})


def sample(df: DataFrame, n: int, key: str, seed: str = "13") -> DataFrame:
    """n rows in the order of a hash of their key: the same ones every time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
