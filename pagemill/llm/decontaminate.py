"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

An item is a short text. A document is contaminated if a window of it, as many words long as the item, has a
shingle similarity to the item, weighted or plain, of at least the threshold. Words are runs of letters and digits of the
lower-cased text (every character beyond ASCII belongs to a word), so punctuation glued to a passage doesn't
hide it. Shingles are five words; an item of fewer words is one shingle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.arrow import grouped, map_batches
from pagemill.llm.words import NOT_ALNUM, U, sequence_hashes, words

BITS, BLOCKS = 64, 8
WIDTH = BITS // BLOCKS
_FILTER = 1 << 22


class Match(NamedTuple):
    """``radius``: two texts of similarity 0.8 differ in about 10 of 64 bits, standard deviation 3; 24 is
    beyond four of these."""

    width: int = 5
    threshold: float = 0.8
    radius: int = 24
    block_items: int = 20_000


class Items(NamedTuple):
    """Items of one block: ids, windows, shingles by place, weights, and the Hamming index by length.
    ``other_weight`` of an item is its mean weight, which unknown shingles have against it. ``prints`` and
    ``index`` are there twice: weighted and plain."""

    ids: list[int]
    n_words: np.ndarray
    shingles: list[dict[int, int]]
    weight: dict[int, float]
    other_weight: np.ndarray
    vocabulary: np.ndarray
    holders: dict[int, list[int]]
    filter: np.ndarray
    prints: tuple[np.ndarray, np.ndarray]
    index: tuple[dict[int, list[dict[int, list[int]]]], ...]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit, lowest first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def shingles_of(column: pa.Array, width: int):
    """Word row numbers, then for each row group: shingle hashes, their first word and row, word counts."""
    lowered = pc.utf8_lower(column)
    for first, last, data, offsets in grouped(lowered):
        w = words(data, offsets, NOT_ALNUM)
        counts = np.bincount(w.row, minlength=last - first)
        starts = np.cumsum(counts) - counts
        h, at = sequence_hashes(w.hash, w.row, width)
        yield first, w, counts, starts, h, at


def _bags(items: list[tuple[int, str]], rule: Match):
    """(item_id, words, shingle hashes in order) of each item with words."""
    for first, w, counts, starts, h, at in shingles_of(pa.array([t for _, t in items], pa.string()), rule.width):
        by_row = np.split(h, np.searchsorted(w.row[at], np.arange(1, len(counts))))
        for k, n in enumerate(counts.tolist()):
            if n:
                own = by_row[k] if n >= rule.width else sequence_hashes(w.hash[starts[k] : starts[k] + n], w.row[starts[k] : starts[k] + n], n)[0]
                yield items[first + k][0], n, own


def shingle_weights(items: list[tuple[int, str]], rule: Match) -> dict[int, float]:
    """ln(1 + texts / texts with the shingle) over the distinct texts of the whole benchmark: what many texts share
    counts less, and repeats of one text count once."""
    texts = {own.tobytes() for _, _, own in _bags(items, rule)}
    seen = Counter(s for own in texts for s in set(np.frombuffer(own, U).tolist()))
    return {s: float(np.log1p(len(texts) / n)) for s, n in seen.items()}


def compile_items(items: list[tuple[int, str]], rule: Match, weights: dict[int, float] | None = None) -> Items:
    """``weights``: of the whole benchmark, if ``items`` is a block of it."""
    weights = shingle_weights(items, rule) if weights is None else weights
    ids, lengths, bags = [], [], []
    for item_id, n, own in _bags(items, rule):
        ids.append(item_id)
        lengths.append(n)
        bags.append(dict(Counter(own.tolist())))
    weight = {s: weights[s] for bag in bags for s in bag}
    holders: dict[int, list[int]] = defaultdict(list)
    for k, bag in enumerate(bags):
        for s in bag:
            holders[s].append(k)
    vocabulary = np.array(sorted(weight), U)
    flags = np.zeros(_FILTER, bool)
    flags[(vocabulary % U(_FILTER)).astype(np.int64)] = True
    prints = (np.zeros(len(bags), U), np.zeros(len(bags), U))
    index: tuple[dict[int, list[dict[int, list[int]]]], ...] = ({}, {})
    other = np.zeros(len(bags))
    reach = rule.radius // BLOCKS
    flips = [sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(WIDTH), r)]
    for k, bag in enumerate(bags):
        h = np.array(list(bag), U)
        n = np.array(list(bag.values()), float)
        w = np.array([weight[s] for s in bag]) * n
        other[k] = w.sum() / n.sum()
        for kind, each in enumerate((w, n)):
            prints[kind][k] = _pack((_bits(h) * each[:, None]).sum(0, keepdims=True))[0]
            blocks = index[kind].setdefault(lengths[k], [defaultdict(list) for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                own = int(prints[kind][k]) >> (b * WIDTH) & (1 << WIDTH) - 1
                for flip in flips:
                    blocks[b][own ^ flip].append(k)
    return Items(ids, np.array(lengths), bags, weight, other, vocabulary, dict(holders), flags, prints, index)


def similarity(a: dict[int, int], k: int, items: Items) -> float:
    """Jaccard similarity of a shingle multiset and item ``k``'s: the greater of the weighted and the plain one."""
    low = high = plain_low = plain_high = 0.0
    b = items.shingles[k]
    for s in a.keys() | b.keys():
        w = items.weight.get(s, items.other_weight[k])
        x, y = a.get(s, 0), b.get(s, 0)
        low += w * min(x, y)
        high += w * max(x, y)
        plain_low += min(x, y)
        plain_high += max(x, y)
    return max(low / high, plain_low / plain_high) if high else 0.0


def _near(prints: np.ndarray, length: int, items: Items, radius: int, kind: int) -> dict[int, np.ndarray]:
    """For each item of this length: the windows whose fingerprint is within the radius. By the pigeonhole
    principle one of the blocks has at most radius // BLOCKS bits that differ, so the index has them all."""
    found: dict[int, np.ndarray] = {}
    for b in range(BLOCKS):
        block = ((prints >> U(b * WIDTH)) & U((1 << WIDTH) - 1)).astype(np.int64)
        for value in np.unique(block).tolist():
            of = items.index[kind][length][b].get(value)
            if of:
                rows = np.flatnonzero(block == value)
                for k in of:
                    near = rows[np.bitwise_count(prints[rows] ^ items.prints[kind][k]) <= radius]
                    if len(near):
                        found[k] = np.union1d(found[k], near) if k in found else near
    return found


def search(h: np.ndarray, n_words: int, hits: np.ndarray, items: Items, rule: Match) -> dict[int, tuple[float, int]]:
    """{item: (best similarity, first word)} in one document, whose shingles are ``h``.

    A document shorter than the item is compared whole. A window that reaches a positive threshold shares a shingle with the item, so only windows around the
    places of item shingles (``hits``) get a fingerprint.
    """
    lengths = {int(items.n_words[k]) for j in hits.tolist() for k in items.holders[int(h[j])]}
    best: dict[int, tuple[float, int]] = {}
    weights = items.weight
    usual = float(items.other_weight.mean()) if len(items.other_weight) else 0.0
    for length in sorted(lengths):
        span = min(length, n_words) - rule.width + 1  # shingles in a window; a shorter document is one window
        spread = np.zeros(max(n_words - length, 0) + 2, np.int64)
        np.add.at(spread, np.maximum(hits - span + 1, 0).clip(max=len(spread) - 1), 1)
        np.subtract.at(spread, (hits + 1).clip(max=len(spread) - 1), 1)
        starts = np.flatnonzero(np.cumsum(spread)[:-1] > 0)
        cuts = np.flatnonzero(np.diff(starts) > span) + 1
        for part in np.split(starts, cuts):
            for a in range(0, len(part), 4096):
                piece = part[a : a + 4096]
                if not len(piece):
                    continue
                low, top = int(piece[0]), int(piece[-1]) + span
                own = h[low:top]
                w = np.array([weights.get(s, usual) for s in own.tolist()])
                bits, found = _bits(own), {}
                for kind, each in enumerate((bits * w[:, None], bits)):
                    sums = np.zeros((len(own) + 1, BITS))
                    np.cumsum(each, axis=0, out=sums[1:])
                    prints = _pack(sums[piece - low + span] - sums[piece - low])
                    for k, near in _near(prints, length, items, rule.radius, kind).items():
                        found[k] = np.union1d(found[k], near) if k in found else near
                for k, near in found.items():
                    for start in piece[near].tolist():
                        window = Counter(h[start : start + span].tolist())
                        s = similarity(window, k, items)
                        if s >= rule.threshold and (k not in best or (s, -start) > (best[k][0], -best[k][1])):
                            best[k] = (s, start)
    return best


def _short_items(w, counts, starts, row: int, items: Items, rule: Match) -> dict[int, tuple[float, int]]:
    """Items of fewer words than a shingle: their whole sequence, found exactly."""
    best: dict[int, tuple[float, int]] = {}
    for n in {int(x) for x in items.n_words if x < rule.width}:
        a, b = starts[row], starts[row] + counts[row]
        h, _ = sequence_hashes(w.hash[a:b], w.row[a:b], n)
        for k in np.flatnonzero(items.n_words == n).tolist():
            at = np.flatnonzero(h == U(next(iter(items.shingles[k]))))
            if len(at):
                best[k] = (1.0, int(at[0]))
    return best


RESULT = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminations(docs: DataFrame, items: DataFrame, rule: Match = Match(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): for each document and item that meet, the best
    window (the first of equals), counted in words from 0.

    Items are the stated query set: they are taken in blocks of ``block_items``, each block sent to the tasks
    (items are at most some hundred words; one beyond ``block_items`` blocks only adds a pass over the
    documents). Null or wordless texts on either side meet nothing; repeated documents and items each get
    their rows; a null doc_id or item_id stays null.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    result = None
    for block in _blocks(items, rule, item_id, item_text):
        own = _scan(named, block, rule)
        result = own if result is None else result.unionByName(own)
    return result


def _blocks(items: DataFrame, rule: Match, item_id: str, item_text: str) -> Iterator[Items]:
    """The items in blocks, with weights counted over all of them; one empty block if there are none."""
    rows = items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string"))
    every = [(r[0], r[1] or "") for r in rows.toLocalIterator()]
    weights = shingle_weights(every, rule)
    for first in range(0, max(len(every), 1), rule.block_items):
        yield compile_items(every[first : first + rule.block_items], rule, weights)


def _matches(texts: pa.Array, items: Items, rule: Match) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
    """Rows of a batch with the items each meets: similarity and first word of the best window."""
    has_short = bool((items.n_words < rule.width).any())
    for first, w, counts, starts, h, at in shingles_of(texts, rule.width):
        maybe = np.flatnonzero(items.filter[(h % U(_FILTER)).astype(np.int64)])
        if len(maybe):
            place = np.searchsorted(items.vocabulary, h[maybe])
            maybe = maybe[items.vocabulary[np.minimum(place, len(items.vocabulary) - 1)] == h[maybe]]
        row_of = w.row[at]
        rows = set(np.unique(row_of[maybe]).tolist())
        for row in sorted(rows | set(range(len(counts))) if has_short else rows):
            a, b = np.searchsorted(row_of, [row, row + 1])
            found = search(h[a:b], int(counts[row]), maybe[(maybe >= a) & (maybe < b)] - a, items, rule) if row in rows else {}
            if has_short:
                found |= _short_items(w, counts, starts, row, items, rule)
            if found:
                yield first + row, found


def _scan(docs: DataFrame, items: Items, rule: Match) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, ids = shared.value, batch.column(0).to_pylist()
        out: list[tuple] = []
        for row, found in _matches(batch.column(1), items, rule):
            out += [(ids[row], items.ids[k], s, start, int(items.n_words[k])) for k, (s, start) in found.items()]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return map_batches(docs, run, RESULT)


def decontaminated(docs: DataFrame, items: DataFrame, rule: Match = Match(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that meet no item, with all their columns. The verdict is made row by row in the scan, one scan
    after the other for the blocks of items; no join brings it back, so nulls and repeated ids don't matter and no
    text is shuffled. Null and wordless texts stay."""
    names, left = docs.columns, docs
    for block in _blocks(items, rule, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, _ in _matches(batch.column(len(names)), shared.value, rule)]] = False
            rest = batch.select(list(range(len(names)))).filter(pa.array(keep))
            return rest if rest.num_rows else None

        left = map_batches(left.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("_text")), run, docs.schema)
    return left
