"""Character trigrams for language scoring."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_CHARACTERS = 1 << 20


def letters_only(text: Column) -> Column:
    """Lower-case letters, each run of anything else one blank, one blank at both ends. Text without
    a letter becomes two blanks, too short for a trigram."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def characters(letters: Column) -> Column:
    return F.split(letters, "")


def trigram_parts(chars: Column) -> Column:
    """Array of (c1, c2, c3): a character array zipped with itself shifted, so the work is linear in
    its length. The last two entries lack c3. ``chars`` should be a column of its own projection;
    as an expression it would be computed for each of its uses here."""
    return F.arrays_zip(
        chars.alias("c1"),
        F.slice(chars, F.lit(2), F.size(chars)).alias("c2"),
        F.slice(chars, F.lit(3), F.size(chars)).alias("c3"),
    )


def explode_grams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row (keys, gram) per trigram of ``text``; texts without letters give none."""
    chars = df.select(*keys, characters(letters_only(F.col(text))).alias("_chars"))
    return (
        chars.select(*keys, F.inline(trigram_parts(F.col("_chars"))).alias("c1", "c2", "c3"))
        .filter(F.col("c3").isNotNull())
        .select(*keys, F.concat("c1", "c2", "c3").alias("gram"))
    )


class GramGroup(NamedTuple):
    """Rows ``first`` to ``last`` of a column of texts, their characters in one line: where each row starts and ends, the
    trigram that starts at each character as one number of three code points, and whether it ends in the same row."""

    first: int
    last: int
    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    whole: np.ndarray


def gram_groups(letters: pa.Array) -> Iterator[GramGroup]:
    """Trigrams of texts, in groups of rows of bounded size; a longer row stands alone."""
    lengths = pc.fill_null(pc.utf8_length(letters), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, before + GROUP_CHARACTERS, "right")))
        text = "".join(x for x in letters.slice(first, last - first).to_pylist() if x)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        start, end = ends[first:last] - lengths[first:last] - before, ends[first:last] - before
        codes, whole = np.zeros(len(points), np.int64), np.ones(len(points), bool)
        codes[:-2] = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        filled = end[end > start]
        whole[filled - 1] = whole[np.maximum(filled - 2, 0)] = False
        yield GramGroup(first, last, start, end, codes, whole)
        first = last


def gram_texts(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    return [text[k : k + 3] for k in range(0, len(text), 3)]


def count_grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, cnt): trigrams of all texts of a key. Tasks count within groups of rows, Spark sums the counts."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            keys = coded.indices.to_numpy(zero_copy_only=False)
            for g in gram_groups(batch.column(1)):
                of_row = keys[g.first : g.last]
                of_gram = np.repeat(of_row, g.end - g.start)
                for k in np.unique(of_row):
                    codes, n = np.unique(g.codes[g.whole & (of_gram == k)], return_counts=True)
                    same = coded.dictionary.take(pa.array(np.full(len(codes), k)))
                    yield pa.RecordBatch.from_arrays([same, pa.array(gram_texts(codes), pa.string()), pa.array(n, pa.int64())], [key, "gram", "n"])

    thin = df.select(key, letters_only(F.col(text)).alias("letters"))
    schema = T.StructType([thin.schema[key], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    counted = thin.mapInArrow(run, schema).groupBy(key, "gram")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cnt"))


def gram_weigher(grams: list[str], weights: np.ndarray):
    """A function of texts and of numbers of their characters: an array per text, of how many of its trigrams are among
    ``grams``, their sums of each column of ``weights``, and these sums of the trigrams inside of that many characters."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
    known, at = np.unique(points[:, 0] << 42 | points[:, 1] << 21 | points[:, 2], return_inverse=True)
    # Numbers of no trigram come last, without weight.
    table = np.zeros((weights.shape[1], len(known) + 1), np.int64)
    for column, row in zip(weights.T, table, strict=True):
        np.add.at(row, at, column)
    known = np.append(known, np.iinfo(np.int64).max)

    @F.arrow_udf("array<bigint>")
    def weigh(letters: pa.Array, inside: pa.Array) -> pa.Array:
        width = 1 + 2 * len(table)
        out = np.zeros((len(letters), width), np.int64)
        counted = pc.fill_null(inside, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for g in gram_groups(letters):
            found = np.searchsorted(known, g.codes)
            found[~g.whole | (known[found] != g.codes)] = len(known) - 1
            within = g.start + np.clip(counted[g.first : g.last] - 2, 0, g.end - g.start)
            sums = np.zeros(len(found) + 1, np.int64)
            rows = out[g.first : g.last]
            np.cumsum(found < len(known) - 1, out=sums[1:])
            rows[:, 0] = sums[g.end] - sums[g.start]
            for k, row in enumerate(table):
                np.cumsum(row[found], out=sums[1:])
                rows[:, 1 + k] = sums[g.end] - sums[g.start]
                rows[:, 1 + len(table) + k] = sums[within] - sums[g.start]
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return weigh
