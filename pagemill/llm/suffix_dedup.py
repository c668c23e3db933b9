"""Exact removal of long repeated strings by anchored sorting of fixed windows.

A byte goes if it lies in a ``length``-byte string that also starts in a document with a smaller id.

The method asked for is a run-length Burrows-Wheeler index with samples at the runs' ends, through which text
is streamed backwards for match lengths. Sorting of windows takes its place here: one index over a whole corpus
is neither small nor distributable, and only matches of ``length`` bytes count, so longer match lengths aren't
needed. The corpus is cut so that every possible match falls into one bucket:

* Each ``length``-byte window has an anchor: its k-gram of least hash, the first of equals. Equal windows have
  equal anchors at the same place. Neighbouring windows mostly share it, so a text has few anchors.
* Anchors whose k-gram occurs in one document only can't be part of a match; they are dropped first.
* For the others, the text around the anchor (all windows that have it) goes to the bucket of its k-gram, equal
  pieces of one block of documents once, under their least id.
* A bucket sorts its pieces by the suffix at the anchor, then steps backwards byte by byte; each step is a stable
  sort by the byte before, done run by run, and gives the order of the suffixes one byte longer. The full order is
  kept; runs are found again in each step and not stored, and no match lengths are made. Equal pieces are one
  entry, with their least id. Windows that agree on ``length`` bytes are neighbours, and one matches an earlier
  document if the least id of its neighbours is smaller.

Everything is exact: hashes only choose anchors and buckets, windows are compared byte by byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.arrow import map_batches, row_groups, text_bytes
from pagemill.llm.words import U, mix
from pagemill.session import materialize

CHUNK = 1 << 16
_POSITION_BITS = 17
_LAST = np.iinfo(np.int64).max
_GOLDEN = U(0x9E3779B97F4A7C15)
_C1, _C2 = U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


class Plan(NamedTuple):
    """``hot``: a k-gram with more pieces than this is split by the content of its windows."""

    length: int = 50
    anchor: int = 20
    block_bytes: int = 4 << 20
    bucket_bytes: int = 8 << 20
    hot: int = 50_000
    heavy: int = 64

    @property
    def reach(self) -> int:
        return self.length - self.anchor


# --- anchors -------------------------------------------------------------------------------------


def _loads(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number at each byte; data must have 8 bytes more than are asked for."""
    n = len(data) - 8
    out = np.empty(n, U)
    for k in range(8):
        part = out[k::8]
        part[:] = data[k : k + 8 * len(part)].view("<u8")
    return out


def _kgrams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes (8 to 24) at each place where there are so many."""
    n = len(data) - k + 1
    at = _loads(np.concatenate([data, np.zeros(8, np.uint8)]))
    h = at[:n] * _GOLDEN
    h ^= h >> U(29)
    h += at[min(8, k - 8) : min(8, k - 8) + n]
    h *= _C1
    h ^= h >> U(32)
    h += at[k - 8 : k - 8 + n]
    h *= _C2
    h ^= h >> U(31)
    h *= _GOLDEN
    h ^= h >> U(30)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


class Anchors(NamedTuple):
    place: np.ndarray  # of the k-gram
    first: np.ndarray  # start of the first window that has it
    count: np.ndarray  # how many consecutive windows have it
    hash: np.ndarray
    doc: np.ndarray  # row of the document


def anchors(data: np.ndarray, offsets: np.ndarray, plan: Plan) -> Anchors:
    places, firsts, hashes = [], [], []
    n_windows = max(0, len(data) - plan.length + 1)
    for low in range(0, n_windows, CHUNK):
        top = min(low + CHUNK, n_windows)
        h = _kgrams(data[low : top + plan.length - 1], plan.anchor)
        keys = (h >> U(_POSITION_BITS) << U(_POSITION_BITS)) | np.arange(len(h), dtype=U)
        own = (_least(keys, plan.reach + 1) & U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(own, prepend=-1))
        places.append(own[new] + low)
        firsts.append(new + low)
        hashes.append(h[own[new]])
    empty = np.empty(0, np.int64)
    if not places:
        return Anchors(empty, empty, empty, np.empty(0, U), empty)
    place, first, h = np.concatenate(places), np.concatenate(firsts), np.concatenate(hashes)
    end = np.append(first[1:], n_windows)
    # a window belongs to the document of its anchor; those that cross an end of it are cut off
    doc = np.searchsorted(offsets, place, "right") - 1
    first = np.maximum(first, offsets[doc])
    end = np.minimum(end, offsets[doc + 1] - plan.length + 1)
    some = end > first
    place, first, end, h, doc = place[some], first[some], end[some], h[some], doc[some]
    if len(place):  # an anchor that goes on in the next chunk was found twice
        new = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.add.reduceat(end - first, new)
        place, first, h, doc = place[new], first[new], h[new], doc[new]
    else:
        count = empty
    return Anchors(place, first, count, h, doc)


# --- pieces of text around anchors ---------------------------------------------------------------


class Pieces(NamedTuple):
    """Distinct pieces of one block, in the order in which they are sent, and each anchor's piece."""

    text: np.ndarray  # a row of 2 * reach + anchor bytes, the anchor in the middle, zeros outside
    before: np.ndarray  # bytes before the anchor
    count: np.ndarray  # windows
    doc: np.ndarray  # least id
    bucket: np.ndarray
    of: np.ndarray  # piece of each place below
    first: np.ndarray
    windows: np.ndarray
    ids: np.ndarray


def _row_hash(text: np.ndarray, *more: np.ndarray) -> np.ndarray:
    h = np.zeros(len(text), U)
    for column in np.ascontiguousarray(text).view("<u8").T:
        h = mix(h * _GOLDEN + column)
    for column in more:
        h = mix(h * _GOLDEN + column.astype(U))
    return h


def _distinct(order: np.ndarray, keys: np.ndarray, text: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """In an order by ``keys``: where something differs from the one before."""
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    new[1:] = keys[a] != keys[b]
    close = np.flatnonzero(~new[1:])
    differ = (text[a[close]] != text[b[close]]).any(1)
    for column in more:
        differ |= column[a[close]] != column[b[close]]
    new[1 + close[differ]] = True
    return new


def pieces(data, offsets, ids, found: Anchors, shared: np.ndarray, hot: np.ndarray, n_buckets: int, plan: Plan) -> Pieces:
    at = np.flatnonzero(shared)
    place, first, count, h = found.place[at], found.first[at], found.count[at], found.hash[at]
    doc, is_hot = ids[found.doc[at]], hot[at]
    if is_hot.any():  # one piece for each window
        times = np.where(is_hot, count, 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place, first, h, doc = (np.repeat(x, times) for x in (place, first, h, doc))
        hot_row = np.repeat(is_hot, times)
        first = first + np.where(hot_row, step, 0)
        count = np.where(hot_row, 1, np.repeat(count, times))
    else:
        hot_row = np.zeros(len(place), bool)
    width = 2 * plan.reach + plan.anchor
    columns = np.arange(width)
    before = place - first
    begin, end = plan.reach - before, plan.reach - before + count - 1 + plan.length
    padded = np.concatenate([np.zeros(width, np.uint8), data, np.zeros(width, np.uint8)])
    text = np.lib.stride_tricks.sliding_window_view(padded, width)[place + width - plan.reach]
    text[(columns < begin[:, None]) | (columns >= end[:, None])] = 0
    keys = _row_hash(text, before, count)
    bucket = (mix(np.where(hot_row, keys, h) ^ _C1) % U(n_buckets)).astype(np.int64)
    order = np.lexsort((keys, h, bucket))
    new = _distinct(order, keys, text, before, count)
    heads = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], heads) if len(heads) else np.empty(0, np.int64)
    pick = order[heads]
    return Pieces(text[pick], before[pick], count[pick], least, bucket[pick], of, first, count, doc)


# --- the windows of one bucket ----------------------------------------------------------------------


def matches(text: np.ndarray, before: np.ndarray, count: np.ndarray, doc: np.ndarray, plan: Plan) -> np.ndarray:
    """For each piece, a bit for each of its windows, lowest first: whether the window occurs in a piece
    of a smaller document."""
    keys = _row_hash(text, before, count)
    order = np.lexsort((doc, keys))
    new = _distinct(order, keys, text, before, count)
    heads = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    pick = order[heads]  # one entry of the index for equal pieces; its sample is the least document
    t, la, nw, sample = text[pick], before[pick], count[pick], doc[pick]
    out = np.zeros(len(pick), np.uint64)
    # the suffixes at the anchor, sorted
    tail = np.zeros((len(pick), 8 * -(-plan.length // 8)), np.uint8)
    tail[:, : plan.length] = t[:, plan.reach : plan.reach + plan.length]
    at = np.lexsort(tail.view(">u8").T[::-1])
    for depth in range(plan.reach + 1):
        column = plan.reach - depth
        live = at[(la[at] >= depth) & (depth > la[at] - nw[at])]
        if len(live):
            window = t[live, column : column + plan.length]
            cut = np.ones(len(live), bool)
            cut[1:] = (window[1:] != window[:-1]).any(1)
            heads_here = np.flatnonzero(cut)
            least = np.minimum.reduceat(sample[live], heads_here)
            hit = sample[live] > np.repeat(least, np.diff(np.append(heads_here, len(live))))
            out[live[hit]] |= U(1) << (la[live[hit]] - depth).astype(U)
        at = at[la[at] > depth]
        if not len(at):
            break
        # LF: runs of the transform move by their head
        head = t[at, column - 1]
        start = np.flatnonzero(np.diff(head.astype(np.int16), prepend=-1))
        size = np.diff(np.append(start, len(at)))
        moved = np.argsort(head[start], kind="stable")
        start, size = start[moved], size[moved]
        at = at[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
    whole = (U(1) << count.astype(U)) - U(1)
    return np.where(doc > sample[entry], whole, out[entry])


# --- packed rows ----------------------------------------------------------------------------------


def _ints(value, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(bucket)).tolist(), strict=False):
        yield int(bucket[a]), a, b


def _grams(found: Anchors, ids: np.ndarray, n_buckets: int):
    """Distinct k-gram hashes of a block in sending order, each anchor's number among them, how many
    anchors each has, and whether these are in several documents."""
    bucket = (mix(found.hash) % U(n_buckets)).astype(np.int64)
    order = np.lexsort((found.hash, bucket))
    h = found.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    heads = np.flatnonzero(new)
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    docs = ids[found.doc[order]]
    n = np.diff(np.append(heads, len(h)))
    several = (
        np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads) if len(heads) else np.empty(0, bool)
    )
    return h[heads], bucket[order][heads], of, n, several


def _short(hashes: np.ndarray) -> bytes:
    """40 bits of each hash; the bucket tells more."""
    return np.ascontiguousarray((hashes >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(value) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _block(row: dict):
    """Bytes, offsets and ids of a row of the table of blocks."""
    return np.frombuffer(row["data"].as_buffer(), np.uint8), _ints(row["offsets"]), _ints(row["ids"])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}


# --- the job --------------------------------------------------------------------------------------


def _to_blocks(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            for a, b in row_groups(offsets, plan.block_bytes):
                own = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                yield _batch(
                    ["block", "n_bytes", "ids", "offsets", "data"],
                    [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()],
                    [(task << 32 | number, len(part), ids[a:b].tobytes(), own.tobytes(), part.tobytes())],
                )
                number += 1

    return run


def _send_grams(plan: Plan, n_buckets: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in _rows(batch):
            data, offsets, ids = _block(row)
            h, bucket, _, n, several = _grams(anchors(data, offsets, plan), ids, n_buckets)
            for q, a, b in _slices(bucket):
                heavy = np.flatnonzero(n[a:b] >= plan.heavy)
                out.append(
                    (
                        row["block"].as_py(),
                        q,
                        _short(h[a:b]),
                        np.packbits(several[a:b]).tobytes(),
                        np.stack([heavy, n[a:b][heavy]]).astype("<i4").tobytes(),
                    )
                )
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return _batch(["block", "bucket", "grams", "several", "heavy"], kinds, out)

    return run


def _judge_grams(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_batches()
        sizes, grams, several, weight, key = [], [], [], [], []
        for batch in rows:
            for row in _rows(batch):
                own = _long(row["grams"])
                grams.append(own)
                sizes.append(len(own))
                several.append(np.unpackbits(np.frombuffer(row["several"].as_buffer(), np.uint8), count=len(own)))
                w = np.ones(len(own), np.int64)
                heavy = _ints(row["heavy"], "<i4").reshape(2, -1)
                w[heavy[0]] = heavy[1]
                weight.append(w)
                key.append((row["block"].as_py(), row["bucket"].as_py()))
        h, s, w = np.concatenate(grams), np.concatenate(several), np.concatenate(weight)
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        n = np.diff(np.append(heads, len(h)))
        shared = (n > 1) | (np.maximum.reduceat(s[order], heads) > 0)
        hot = np.add.reduceat(w[order], heads) > plan.hot
        flags = np.empty(len(h), np.uint8)
        flags[order] = np.repeat(shared + 2 * (shared & hot), n)
        out, at = [], 0
        for (block, bucket), size in zip(key, sizes, strict=True):
            own = flags[at : at + size]
            out.append((block, bucket, np.packbits(own & 1).tobytes(), np.flatnonzero(own & 2).astype("<i4").tobytes()))
            at += size
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_batches([_batch(["block", "bucket", "shared", "hot"], kinds, out)])

    return run


def _cut(row: dict, plan: Plan, n_grams: int, n_buckets: int):
    """The pieces of a block from its text and the verdicts on its k-grams."""
    data, offsets, ids = _block(row)
    found = anchors(data, offsets, plan)
    h, bucket, of, _, _ = _grams(found, ids, n_grams)
    verdicts = {x["bucket"]: x for x in row["verdicts"].as_py() or []}
    shared, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for q, a, b in _slices(bucket):
        v = verdicts[q]
        shared[a:b] = np.unpackbits(np.frombuffer(v["shared"], np.uint8), count=b - a)
        hot[a + np.frombuffer(v["hot"], "<i4")] = True
    return data, offsets, ids, pieces(data, offsets, ids, found, shared[of], hot[of], n_buckets, plan)


def _send_pieces(plan: Plan, n_grams: int, n_buckets: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in _rows(batch):
            *_, p = _cut(row, plan, n_grams, n_buckets)
            columns = np.arange(p.text.shape[1])
            begin = plan.reach - p.before
            inside = (columns >= begin[:, None]) & (columns < (begin + p.count - 1 + plan.length)[:, None])
            for q, a, b in _slices(p.bucket):
                shape = np.stack([p.before[a:b], p.count[a:b]]).astype(np.uint8)
                out.append((row["block"].as_py(), q, p.text[a:b][inside[a:b]].tobytes(), shape.tobytes(), p.doc[a:b].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return _batch(["block", "bucket", "text", "shape", "docs"], kinds, out)

    return run


def _judge_pieces(plan: Plan):
    width = 2 * plan.reach + plan.anchor

    def run(table: pa.Table) -> pa.Table:
        key, sizes, texts, before, count, docs = [], [], [], [], [], []
        for batch in table.to_batches():
            for row in _rows(batch):
                shape = np.frombuffer(row["shape"].as_buffer(), np.uint8).reshape(2, -1).astype(np.int64)
                before.append(shape[0])
                count.append(shape[1])
                docs.append(_ints(row["docs"]))
                texts.append(np.frombuffer(row["text"].as_buffer(), np.uint8))
                sizes.append(shape.shape[1])
                key.append((row["block"].as_py(), row["bucket"].as_py()))
        before, count, docs = np.concatenate(before), np.concatenate(count), np.concatenate(docs)
        begin = plan.reach - before
        text = np.zeros((len(docs), width), np.uint8)
        columns = np.arange(width)
        text[(columns >= begin[:, None]) & (columns < (begin + count - 1 + plan.length)[:, None])] = np.concatenate(texts)
        masks = matches(text, before, count, docs, plan)
        out, at = [], 0
        for (block, bucket), size in zip(key, sizes, strict=True):
            out.append((block, bucket, masks[at : at + size].astype("<u4").tobytes()))
            at += size
        return pa.Table.from_batches([_batch(["block", "bucket", "masks"], [pa.int64(), pa.int64(), pa.binary()], out)])

    return run


def _remove(plan: Plan, n_grams: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, offsets, ids, p = _cut(row, plan, n_grams, n_buckets)
                masks = np.zeros(len(p.doc), np.uint64)
                answers = {x["bucket"]: x["masks"] for x in row["answers"].as_py() or []}
                for q, a, b in _slices(p.bucket):
                    masks[a:b] = np.frombuffer(answers[q], "<u4")
                whole = (U(1) << p.windows.astype(U)) - U(1)
                own = np.where(p.ids > p.doc[p.of], whole, masks[p.of]) if len(p.of) else np.empty(0, np.uint64)
                cover = np.zeros(len(data) + 1, np.int32)
                for k in range(plan.reach + 1):
                    at = p.first[(own >> U(k)) & U(1) > 0] + k
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + plan.length, 1)
                gone = np.cumsum(cover[:-1]) > 0
                before = np.zeros(len(data), bool)
                before[1:] = gone[:-1]
                before[offsets[:-1][np.diff(offsets) > 0]] = False
                after = np.zeros(len(data), bool)
                after[:-1] = gone[1:]
                after[offsets[1:][np.diff(offsets) > 0] - 1] = False
                start, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
                cuts = np.searchsorted(start, offsets)
                kept = []
                for k in range(len(ids)):
                    a, b = offsets[k], offsets[k + 1]
                    kept.append(data[a:b][~gone[a:b]].tobytes() if cuts[k] < cuts[k + 1] else data[a:b].tobytes())
                of = np.searchsorted(offsets, start, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - offsets[of]), pa.array(end - offsets[of])], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=ids == _LAST),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return run


def suffix_dedup(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) of each row of ``docs``.

    A null text is empty; texts shorter than ``length`` keep all. A null id counts as greater than all
    others. Rows with one id are one document to each other: they remove nothing from one another. Other
    columns are left out. Blocks of documents are stored once, bucketed, so that the two joins with what
    the buckets answer don't move any text; the table stays in the warehouse for the lazy result.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"pagemill_blocks_{uuid.uuid4().hex[:16]}"
    schema = "block long, n_bytes long, ids binary, offsets binary, data binary"
    (
        named.mapInArrow(_to_blocks(plan), schema)
        .write.format("parquet")
        .option("compression", "zstd")
        .bucketBy(n_files, "block")
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(1, -(-total // plan.bucket_bytes))
    grams = map_batches(
        blocks.select("block", "ids", "offsets", "data"),
        _send_grams(plan, n),
        "block long, bucket long, grams binary, several binary, heavy binary",
    )
    verdicts = grams.groupBy("bucket").applyInArrow(_judge_grams(plan), "block long, bucket long, shared binary, hot binary")
    verdicts = materialize(verdicts, "verdicts")
    verdicts = verdicts.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("verdicts"))
    known = blocks.select("block", "ids", "offsets", "data").join(verdicts.hint("shuffle_hash"), "block", "left")
    sent = map_batches(known, _send_pieces(plan, n, n), "block long, bucket long, text binary, shape binary, docs binary")
    answers = sent.groupBy("bucket").applyInArrow(_judge_pieces(plan), "block long, bucket long, masks binary")
    answers = materialize(answers, "answers")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "masks")).alias("answers"))
    return known.join(answers.hint("shuffle_hash"), "block", "left").mapInArrow(
        _remove(plan, n, n), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


def digest(result: DataFrame) -> DataFrame:
    """Counts and the SHA-256 of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return result.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
