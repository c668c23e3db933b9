"""URL filter: rules by host and path, and for the rest the ratio of two character language models.

Accepted and rejected URLs each train a variable-order Markov model of characters: the chance of a byte after
its context of k bytes is smoothed with the one after k - 1 bytes, down to a uniform one. A URL's score is the
log-likelihood difference of the models by byte; the threshold is calibrated on held-out URLs. Counts are
exact for each context and each context with its byte; the table of them grows with the corpus and is joined
to the n-grams of the URLs, never gathered in one place.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.llm.arrow import grouped, row_groups, text_bytes
from pagemill.llm.words import U
from pagemill.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_STEP = U(0xD1342543DE82EF95)
#: URLs that are scored together.
BATCH_BYTES = 128 << 10


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


class Model(NamedTuple):
    """``order``: longest context. ``weight``: how many observations the shorter context's estimate is worth.
    ``held_out``: one URL in so many calibrates and isn't counted.
    Scores are calibrated on a grid of ``grid`` steps over [-span, span]."""

    order: int = 5
    weight: float = 1.0
    held_out: int = 10
    span: float = 4.0
    grid: int = 800


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(name, allow) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<name: string, allow: boolean>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def _grams(data: np.ndarray, offsets: np.ndarray, order: int):
    """For each order: the key of each byte's context, and of the context with the byte. Keys are the bytes
    themselves as digits up to order 6, so they never collide; for longer contexts they are 64-bit hashes."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) - offsets[row]
    byte = data.astype(U) + U(1)
    base = U(257) if order <= 6 else _STEP
    context = np.zeros(len(data), U)
    for k in range(order + 1):
        if k:  # the byte k before; 0 before a URL's start
            earlier = np.zeros(len(data), U)
            earlier[k:] = byte[:-k]
            context = context * base + np.where(place >= k, earlier, U(0))
        own = (context * U(order + 1) + U(k)) * U(257)
        yield own.view(np.int64), (own + byte).view(np.int64)


def _log_likelihood(keys: list, offsets: np.ndarray, known: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Of each byte under one class, whose counts are ``n`` at the sorted keys ``known``."""
    p = np.full(offsets[-1], 1 / 256)
    for context, pair in keys:
        total, own = _looked_up(context, known, n), _looked_up(pair, known, n)
        p = (own + model.weight * p) / (total + model.weight)
    return np.log(p)


def _looked_up(keys: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, n[at], 0).astype(float)


def scores(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, counts: tuple[np.ndarray, np.ndarray], model: Model) -> np.ndarray:
    """Mean difference of log-likelihoods; 0 for an empty URL. ``counts``: of rejected and accepted URLs."""
    keys = list(_grams(data, offsets, model.order))
    both = [_log_likelihood(keys, offsets, known, counts[k], model) for k in (1, 0)]
    sums = np.concatenate([[0.0], np.cumsum(both[0] - both[1])])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


class Trained(NamedTuple):
    """``counts``: (key, rejected, accepted) of each n-gram and context that training saw."""

    counts: DataFrame
    threshold: float
    accuracy: float
    model: Model


def count(urls: DataFrame, model: Model) -> DataFrame:
    """(key, rejected, accepted): how often each n-gram and each context occurs in the rows (url, accepted)."""

    def run(batches):
        for batch in batches:
            accepted = batch.column(1).to_numpy()
            for first, last, data, offsets in grouped(batch.column(0)):
                cls = np.repeat(accepted[first:last], np.diff(offsets)).astype(np.int64)
                for both in _grams(data, offsets, model.order):
                    for keys in both:
                        own, place = np.unique(keys, return_inverse=True)
                        n = np.bincount(place * 2 + cls, minlength=2 * len(own)).reshape(-1, 2).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], ["key", "rejected", "accepted"])

    partial = urls.select("url", "accepted").mapInArrow(run, "key long, rejected long, accepted long")
    return partial.groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def scored(urls: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The rows of ``urls``, whose last column is ``url``, with their score.

    URLs are stored in batches of bounded bytes. Each batch asks once for every n-gram it has, the answers are
    joined from ``counts`` by key, and the batch is scored with its own answers: no task holds the model.
    """
    names = urls.columns
    last = len(names) - 1

    def number(batches):
        task, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(last))
            for a, b in row_groups(offsets, BATCH_BYTES):
                own = pa.array(np.full(b - a, task + n))
                n += 1
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, own], [*names, "batch"])

    kinds = StructType(list(urls.schema.fields)).add("batch", "long")
    stored = materialize(urls.mapInArrow(number, kinds), "url-batches")

    def ask(batches):
        for batch in batches:
            own = batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(0))
            of = np.repeat(own, np.diff(offsets))
            for both in _grams(data, offsets, model.order):
                for keys in both:
                    for b in np.unique(own):
                        some = np.unique(keys[of == b])
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), b))], ["key", "batch"])

    asked = stored.select("url", "batch").mapInArrow(ask, "key long, batch long")
    # a stored batch may be read in two pieces; each key is answered once
    answers = asked.distinct().join(counts, "key").select("batch", "key", "rejected", "accepted")

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("key")
        keys, *n = (known.column(c).to_numpy() for c in ("key", "rejected", "accepted"))
        data, offsets = text_bytes(rows.column("url"))
        return rows.drop_columns("batch").append_column("score", pa.array(scores(data, offsets, keys, tuple(n), model)))

    out = StructType(list(urls.schema.fields)).add("score", "double")
    return stored.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(judge, out)


def train(urls: DataFrame, model: Model = Model()) -> Trained:
    """From all rows (url string, accepted boolean). Null URLs are passed over.

    With one class only, every score is on its side of the threshold; with no URLs, all are accepted.
    """
    urls = urls.select(F.col("accepted").cast("int").alias("accepted"), F.coalesce("url", F.lit("")).alias("url"))
    fold = F.pmod(F.xxhash64("url"), F.lit(model.held_out)) == 0
    counts = materialize(count(urls.where(~fold), model), "url-ngrams")
    step = F.floor((F.col("score") + model.span) / (2 * model.span) * model.grid).cast("long")
    placed = scored(urls.where(fold), counts, model).select(F.greatest(F.lit(0), F.least(step, F.lit(model.grid - 1))).alias("step"), "accepted")
    histogram = np.zeros((2, model.grid + 1))
    for r in placed.groupBy("step", "accepted").agg(F.count("*").alias("n")).collect():
        histogram[r.accepted, r.step] = r.n
    # at threshold k, steps from k on are accepted: the share of each class on the wrong side
    totals = np.maximum(histogram.sum(1), 1)
    wrong_rejected = histogram[0][::-1].cumsum()[::-1] / totals[0]
    wrong_accepted = (histogram[1].cumsum() - histogram[1]) / totals[1]
    error = wrong_rejected + wrong_accepted
    best = np.flatnonzero(error == error.min())
    at = best[len(best) // 2]
    threshold = -model.span + 2 * model.span * at / model.grid
    return Trained(counts, float(threshold), float(1 - error.min() / 2), model)


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: Model = Model(), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of ``pages``.

    URLs that a rule judges train the models; the others are judged by them, on host and path. A null URL
    or one without ``://`` has an empty host and path, fits no rule and scores 0. Repeated rows get the same.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("url", F.concat("host", "path"))
    trained = train(rows.where("best is not null").select("url", F.col("best.allow").alias("accepted")), model)
    judged = scored(rows, trained.counts, model)
    allow = F.coalesce("best.allow", F.col("score") >= trained.threshold)
    return judged.select(
        "page_id", "host", "path", F.col("best.name").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), "score"
    )
