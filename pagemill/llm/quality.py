"""Quality rules by the divergence of histograms from references of the document's language.

Every document has a histogram of character classes and one of the common words of its language. Their
Jensen-Shannon distance (root of the divergence, base 2: 0 to 1) to the language's reference tells how
unlike ordinary text it is. References are means over all documents of the language that pass the base
rules and are long enough, each document weighing the same, so that no long one rules them. Words are counted by
their 64-bit hashes, for every language, however many there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.arrow import grouped, map_batches
from pagemill.llm.words import (
    NEWLINE,
    WHITE,
    per_row,
    run_hashes,
    runs,
    sequence_hashes,
    table,
    with_row,
    words,
)
from pagemill.session import materialize

SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 8
CLASSES = ("lower", "upper", "digit", "space", "line", "punctuation", "symbol", "ascii", "wide")
#: References of up to so many languages (2 KB each) go to the tasks as a whole; more are joined to the documents.
SHARED_LANGUAGES = 4096
_UNIT = 1_000_000  # weights are summed as integers, so that reruns agree to the last digit


class Rules(NamedTuple):
    """Limits of the rules; a histogram is judged only from its minimum length on."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_chars_judged: int = 400
    min_words_judged: int = 60
    max_char_distance: float = 0.25
    max_word_distance: float = 0.50
    common_words: int = 100
    min_reference: int = 20


def _class_table() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[WHITE] = 3
    out[NEWLINE] = 4
    out[list(b".,;:!?'\"()-")] = 5
    out[list(SYMBOLS)] = 6
    out[0x80:0xC0] = 9  # continuation bytes: not code points of their own
    out[0xC0:] = 8
    return out


_CLASS = _class_table()
_SYMBOL = table(*SYMBOLS)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that occur twice or more; places of all but one of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    again = np.flatnonzero(twice)
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice), again


def measures(data: np.ndarray, offsets: np.ndarray, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """Base counts and histograms of each row of one row group."""
    n = len(offsets) - 1
    w = words(data, offsets)
    lead = (data & 0xC0) != 0x80
    white = WHITE[data]
    out = {
        "n_words": np.bincount(w.row, minlength=n),
        "word_chars": per_row(lead & ~white, offsets),
        "n_symbols": per_row(_SYMBOL[data], offsets),
    }
    start, end, row = runs(data, offsets, NEWLINE)
    sums = np.concatenate([[0], np.cumsum(~white)])
    worded = sums[end] > sums[start]
    start, end, row = start[worded], end[worded], row[worded]
    _, again = _repeats(with_row(run_hashes(data, start, end), row))
    out["n_dup_lines"] = np.bincount(row[again], minlength=n)
    h, at = sequence_hashes(w.hash, w.row, REPEAT_WIDTH)
    twice, _ = _repeats(with_row(h, w.row[at]))
    cover = np.zeros(len(w.row) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.subtract.at(cover, at[twice] + REPEAT_WIDTH, 1)
    out["n_repeat_words"] = np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=n)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"]
    )
    byte_row = np.repeat(np.arange(n) * 10, np.diff(offsets))
    out["chars"] = np.bincount(byte_row + _CLASS[data], minlength=10 * n).reshape(n, 10)[:, :9]
    out["word_row"] = w.row
    out["word_hash"] = w.hash.view(np.int64)
    return out


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one distribution; 1 for a row without counts."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(1)
    out = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return np.where(total[:, 0] > 0, out, 1.0)


class Reference(NamedTuple):
    """Distribution of the character classes; sorted hashes of the common words, and their distribution in that order
    with the rest of the words last."""

    chars: np.ndarray
    words: np.ndarray
    shares: np.ndarray


class References(NamedTuple):
    """``known``: reference by language, ``None`` for that of all documents. ``table``: the languages' stored rows, where
    they are too many for ``known``."""

    known: dict[str | None, Reference]
    table: DataFrame | None = None


def _reference(chars: list, words: list, weights: list, total: int) -> Reference:
    chars, words, weights = np.array(chars, float), np.array(words, np.int64), np.array(weights, float)
    order = np.argsort(words)
    shares = np.append(weights[order], total - weights.sum()) / total
    return Reference(chars / max(chars.sum(), 1), words[order], shares)


STORED = ("chars", "words", "weights", "total")


def language_references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> References:
    """The references of all languages with at least ``min_reference`` judged documents, and that of all documents together.

    Counted over all documents: sums of classes and words combine in the tasks before their shuffle, and the common
    words of a language are ranked in each task first, so a hot language isn't gathered. Of equally common words
    those with the lesser hash count.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(1).to_pylist()
        out: list[list] = [[], [], [], []]
        for first, last, data, offsets in grouped(batch.column(0)):
            m = measures(data, offsets, rules)
            good = np.flatnonzero(~m["base_failed"] & (m["n_words"] >= rules.min_words_judged))
            names = sorted({langs[first + i] for i in good.tolist()}, key=lambda x: (x is None, x))
            number = {x: k for k, x in enumerate(names)}
            of = np.full(last - first, -1)
            of[good] = [number[langs[first + i]] for i in good.tolist()]
            chars = m["chars"] * _UNIT // np.maximum(m["chars"].sum(1, keepdims=True), 1)
            share = (_UNIT // np.maximum(m["n_words"], 1))[m["word_row"]]
            word_of = of[m["word_row"]]
            for k, name in enumerate(names):
                mine = word_of == k
                hashes, at = np.unique(m["word_hash"][mine], return_inverse=True)
                sums = np.bincount(at, share[mine], len(hashes)).astype(np.int64)
                out[0] += [name] * (10 + len(hashes))
                out[1].append(np.concatenate([[0], np.ones(9, np.int64), np.full(len(hashes), 2)]))
                out[2].append(np.concatenate([[0], np.arange(9), hashes]))
                out[3].append(np.concatenate([[(of == k).sum()], chars[of == k].sum(0), sums]))
        flat = [np.concatenate([np.empty(0, np.int64), *x]) for x in out[1:]]
        columns = [pa.array(out[0], pa.string()), pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), pa.array(flat[2])]
        return pa.RecordBatch.from_arrays(columns, ["lang", "kind", "key", "weight"])

    narrow = docs.select(F.col(text).cast("string"), F.col(lang).cast("string"))
    own = map_batches(narrow, count, "lang string, kind int, key long, weight long")
    stored = materialize(own.groupBy("lang", "kind", "key").agg(F.sum("weight").alias("weight")), "language-words")
    pooled = stored.groupBy("kind", "key").agg(F.sum("weight").alias("weight"))
    rows = stored.where("lang is not null").unionByName(pooled.withColumn("lang", F.lit(None).cast("string")))
    order = Window.partitionBy("lang").orderBy(F.desc("weight"), "key")
    common = rows.where("kind = 2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.common_words)
    tops = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "weight"))).alias("top"))
    of_kind = lambda which: F.coalesce(F.sum(F.when(F.expr(which), F.col("weight"))), F.lit(0))
    classes = F.array(*[of_kind(f"kind = 1 and key = {k}") for k in range(9)])
    sums = rows.groupBy(F.col("lang").alias("_of")).agg(of_kind("kind = 0").alias("n"), classes.alias("chars"), of_kind("kind = 2").alias("total"))
    listed = sums.where("total > 0").where(F.col("_of").isNull() | (F.col("n") >= rules.min_reference))
    table = listed.join(tops, F.col("_of").eqNullSafe(F.col("lang"))).select(
        "lang", "chars", F.col("top.key").alias("words"), F.col("top.weight").alias("weights"), "total"
    )
    table = materialize(table, "references")
    many = table.count() > SHARED_LANGUAGES
    sent = table.where("lang is null") if many else table
    known = {r.lang: _reference(*(r[c] for c in STORED)) for r in sent.collect()}
    return References(known, table.where("lang is not null") if many else None)


def with_reference(docs: DataFrame, references: References, lang: str) -> DataFrame:
    """``docs``, and in a last column the stored reference of their language where the tasks don't have all of them.
    The references' table is small beside the documents; where it isn't broadcast, the skew join splits a hot language."""
    table = references.table
    taken = {c.lower() for c in docs.columns}
    of, last = (next(n for n in (f"{'_' * k}{name}" for k in range(1, len(taken) + 2)) if n not in taken) for name in ("of", "reference"))
    if table is None:
        return docs.withColumn(last, F.lit(None).cast("int"))
    return docs.join(table.select(F.col("lang").alias(of), F.struct(*STORED).alias(last)), F.col(lang) == F.col(of), "left").drop(of)


def _of_batch(known: dict[str | None, Reference], langs: list, joined: pa.Array) -> dict[str | None, Reference]:
    """The references a batch needs: those that all tasks have, and one for each language that was joined to it."""
    if joined.null_count == len(joined):
        return known
    out = dict(known)
    for k in np.flatnonzero(joined.is_valid().to_numpy(zero_copy_only=False)).tolist():
        if langs[k] not in out:
            r = joined[k].as_py()
            out[langs[k]] = _reference(*(r[c] for c in STORED))
    return out


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, char_distance double, word_distance double, kept boolean"
)


def _verdicts(texts: pa.Array, langs: list, references: dict, rules: Rules) -> dict[str, np.ndarray]:
    """Counts, distances and verdict of each text, by column of the result."""
    parts: dict[str, list] = {}
    for first, last, data, offsets in grouped(texts):
        m = measures(data, offsets, rules)
        n = last - first
        char, word = np.full(n, np.nan), np.full(n, np.nan)
        own = [x if x in references else None for x in langs[first:last]]
        for name in set(own):
            if name not in references:
                continue
            ref = references[name]
            rows = np.flatnonzero([x == name for x in own])
            char[rows] = distances(m["chars"][rows], ref.chars)
            number = np.full(n, -1)
            number[rows] = np.arange(len(rows))
            mine = number[m["word_row"]]
            hashes = m["word_hash"][mine >= 0]
            place = np.minimum(np.searchsorted(ref.words, hashes), len(ref.words) - 1)
            place[ref.words[place] != hashes] = len(ref.words)
            width = len(ref.words) + 1
            counts = np.bincount(mine[mine >= 0] * width + place, minlength=len(rows) * width)
            word[rows] = distances(counts.reshape(len(rows), -1), ref.shares)
        char[m["chars"].sum(1) < rules.min_chars_judged] = np.nan
        word[m["n_words"] < rules.min_words_judged] = np.nan
        m["char_distance"], m["word_distance"] = char, word
        with np.errstate(invalid="ignore"):
            m["kept"] = ~m["base_failed"] & ~(char > rules.max_char_distance) & ~(word > rules.max_word_distance)
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"):
            parts.setdefault(name, []).append(m[name])
    return {name: np.concatenate(v) for name, v in parts.items()}


def judge(docs: DataFrame, references: References, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and verdict of each row.

    A null text has no words and fails the base rules. A null or unlisted language is compared with the
    reference of all documents, and so is one with too few of them; without any reference, or below the minimum lengths, a distance is null
    and the base rules decide alone. Repeated rows get the same verdict; other columns are left out.
    """

    known = references.known
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(2).to_pylist()
        parts = _verdicts(batch.column(1), langs, _of_batch(known, langs, batch.column(3)), rules)
        columns = [pa.array(v, from_pandas=k.endswith("distance")) for k, v in parts.items()]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *parts])

    return map_batches(with_reference(named, references, "lang"), run, RESULT)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """References from all of ``docs``, then the verdict on each of them."""
    return judge(docs, language_references(docs, rules), rules)


def kept_rows(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. The verdict is made row by row in the
    scan; no join brings it back, so nulls and repeated ids don't matter, and no text is shuffled unless the languages are
    more than the tasks can share."""
    references = language_references(docs, rules)
    known, n = references.known, len(docs.columns)
    lang, text = "_lang", "_text"
    while {lang, text} & {c.lower() for c in docs.columns}:
        lang, text = f"_{lang}", f"_{text}"
    tagged = docs.select(*docs.columns, F.col("text").cast("string").alias(text), F.col("lang").cast("string").alias(lang))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs = batch.column(n + 1).to_pylist()
        keep = _verdicts(batch.column(n), langs, _of_batch(known, langs, batch.column(n + 2)), rules)["kept"]
        left = batch.select(list(range(n))).filter(pa.array(keep))
        return left if left.num_rows else None

    return map_batches(with_reference(tagged, references, lang), run, docs.schema)
