"""Token ids in Arrow files of fixed-size lists.

Documents are dealt by range of their ids and sorted; each partition writes one pair of files into the
shared folder: ``shard-N.arrow`` with batches of equal-length sequences (``input_ids``: lists of unsigned ids, of
16 bits if the vocabulary fits, else 32; ``mask``: true for ids of documents, false for the filling of the last
sequence) and ``shard-N.docs.arrow`` with
(doc_id, start, n_tokens) of its documents. All batches but the last have the same number of sequences, so
any sequence or document is found by arithmetic and read from a memory map without a copy. A task writes
under a name of its own and renames at the end, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.arrow import forget, give_back, remembered, row_groups, text_bytes
from pagemill.llm.words import WHITE, run_hashes
from pagemill.session import materialize, scratch_path

GROUP_BYTES = 2 << 20
JOINED = 50


class Layout(NamedTuple):
    """``tokenizer``: a file of the tokenizers library. ``cached``: pieces of text that a task remembers.
    ``literal_specials``: strings of special tokens in a text are ordinary text, so that web text can't write control
    tokens; by default they are special tokens, as the library has it."""

    tokenizer: str
    end_id: int = 2
    length: int = 2048
    batch: int = 64
    cached: int = 400_000
    literal_specials: bool = False


class Encoder:
    """Ids of whole texts.

    A byte-level tokenizer without normalizer cuts its texts before the last white space of a run, whatever
    else a text holds: the ids of the parts, put together, are the ids of the text. So each distinct part
    of a group of texts is encoded once. Texts that hold an added token, at which the library cuts first, and those for
    other tokenizers are given to it as they are.
    """

    # What may follow a white space at a cut: not white space, nor a first byte of one beyond ASCII.
    _AFTER = ~(WHITE | np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]))

    def __init__(self, layout: Layout):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.layout = layout
        self.tokenizer = Tokenizer.from_file(layout.tokenizer)
        self.tokenizer.encode_special_tokens = layout.literal_specials
        with open(layout.tokenizer) as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.cuts = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not told.get("normalizer")
        )
        added = told.get("added_tokens") or []
        self.added = [t["content"].encode() for t in added if t["content"] and not (layout.literal_specials and t.get("special"))]
        # parts met before: their hashes in order, where the ids of each begin and how many they are
        self.known = np.empty(0, np.uint64)
        self.known_at = self.known_size = np.empty(0, np.int64)
        self.known_ids = np.empty(0, np.uint32)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(max(vocabulary.values()), layout.end_id)
        self.kind = pa.uint16() if top < 1 << 16 else pa.uint32()
        self.n_bytes = np.zeros(top + 1, np.int64)  # a character of a byte-level token is a byte
        for token, k in vocabulary.items():
            self.n_bytes[k] = len(token)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of a text, and how many each has. Up to ``JOINED`` parts go to the library as one text,
        since cuts hold there too; a part that begins a row has no cut before it and begins a text. The
        bytes of the ids tell where each part ends."""
        size = end - start
        parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        first = np.frombuffer(raw, np.uint8)[start] if len(start) else np.empty(0, np.uint8)
        heads = np.flatnonzero((np.arange(len(start)) % JOINED == 0) | ~WHITE[first]).tolist()
        joined = [b"".join(parts[a:b]).decode() for a, b in zip(heads, [*heads[1:], len(parts)], strict=True)]
        ids = [np.array(x, np.uint32) for x in self._encode(joined)]
        flat = np.concatenate([np.empty(0, np.uint32), *ids])
        upto = np.concatenate([[0], np.cumsum(self.n_bytes[flat])])
        ends = np.searchsorted(upto, np.cumsum(size))
        if not np.array_equal(upto[ends], np.cumsum(size)):
            raise ValueError("the tokenizer joins what this encoder cuts")
        return flat, np.diff(ends, prepend=0)

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Whether each row holds the string of an added token."""
        out = np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                out[row] |= at + len(token) <= offsets[row + 1]
                at = raw.find(token, at + 1 if not out[row] else int(offsets[row + 1]))
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, the end id behind each, and how many each row has."""
        raw = data.tobytes()
        odd = self._with_added(raw, offsets) if self.cuts else np.zeros(len(offsets) - 1, bool)
        if not odd.any():
            return self._ids(data, offsets)
        lengths = np.diff(offsets)
        rest = data[~np.repeat(odd, lengths)]
        flat, n_rest = self._ids(rest, np.concatenate([[0], np.cumsum(lengths[~odd])]))
        whole = self._encode([raw[offsets[k] : offsets[k + 1]].decode() for k in np.flatnonzero(odd).tolist()])
        sizes = np.empty(len(odd), np.int64)
        sizes[~odd], sizes[odd] = n_rest, [len(x) + 1 for x in whole]
        out = np.empty(sizes.sum(), np.uint32)
        of_odd = np.repeat(odd, sizes)
        out[~of_odd] = flat
        out[of_odd] = np.fromiter(chain.from_iterable([*x, self.layout.end_id] for x in whole), np.uint32)
        return out, sizes

    def _remembered(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the remembered ids those of each part begin, how many they are, and which parts are known at all."""
        if not len(self.known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return self.known_at[place], self.known_size[place], self.known[place] == h

    def _remember(self, h: np.ndarray, missing: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Keep the first of the missing parts, as many as there is room for; ``ids`` has theirs behind the known ones."""
        new = missing[: max(0, self.layout.cached - len(self.known))]
        if not len(new):
            return
        order = np.argsort(np.concatenate([self.known, h[new]]), kind="stable")
        self.known = np.concatenate([self.known, h[new]])[order]
        self.known_at = np.concatenate([self.known_at, at[new]])[order]
        self.known_size = np.concatenate([self.known_size, size[new]])[order]
        self.known_ids = ids[: len(self.known_ids) + int(size[new].sum())].copy()

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets))
        if not self.cuts:
            texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in full.tolist()]
            ids = self._encode(texts)
            sizes = np.zeros(n, np.int64)
            sizes[full] = [len(x) for x in ids]
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum())
        else:
            cut = np.zeros(len(data), bool)
            cut[:-1] = WHITE[data[:-1]] & self._AFTER[data[1:]]
            cut[offsets[full + 1] - 1] = False  # the last byte of a row has nothing after it
            cut[offsets[full]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))
            part, h = pd.factorize(run_hashes(data, start, end))
            first = np.empty(len(h), np.int64)
            first[part[::-1]] = np.arange(len(part) - 1, -1, -1)
            h = np.asarray(h, np.uint64)
            at, each, known = self._remembered(h)
            missing = np.flatnonzero(~known)
            raw = data.tobytes()
            fresh, count = self._encode_parts(raw, start[first[missing]], end[first[missing]])
            at[missing], each[missing] = len(self.known_ids) + np.cumsum(count) - count, count
            ids = np.concatenate([self.known_ids, fresh])
            self._remember(h, missing, at, each, ids)
            size = each[part]
            begin = np.cumsum(size) - size
            flat = ids[np.arange(size.sum()) - np.repeat(begin - at[part], size)]
            row = np.searchsorted(offsets[full], start, "right") - 1
            sizes = np.zeros(n, np.int64)
            sizes[full] = np.bincount(row, size, len(full)).astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        out = np.full(len(flat) + n, self.layout.end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = flat
        return out, sizes + 1


def encoder(layout: Layout) -> Encoder:
    """One encoder for each worker process and layout: it remembers parts from task to task."""
    return remembered(layout, lambda: Encoder(layout))


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder as a URI, as Spark itself would resolve it: without a scheme it is on Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder:
        raise ValueError(f"{folder} has no scheme, so executors could take it for different places")
    return pafs.FileSystem.from_uri(folder)


def _sequence_schema(layout: Layout) -> pa.Schema:
    kinds = [("input_ids", pa.list_(encoder(layout).kind, layout.length)), ("mask", pa.list_(pa.bool_(), layout.length))]
    told = {"sequence_length": str(layout.length), "sequences_per_batch": str(layout.batch), "tokenizer": os.path.basename(layout.tokenizer)}
    return pa.schema(kinds, metadata=told)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Sequences:
    """Takes ids in any portions and writes batches of full sequences."""

    def __init__(self, sink, layout: Layout):
        self.layout, self.schema = layout, _sequence_schema(layout)
        self.kind = encoder(layout).kind.to_pandas_dtype()
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_all = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_all += len(ids)
        size = self.layout.length * self.layout.batch
        if self.n_held >= size:
            ids = np.concatenate(self.held)
            whole = len(ids) // size * size
            for a in range(0, whole, size):
                self._write(ids[a : a + size], size)
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _write(self, ids: np.ndarray, used: int) -> None:
        values = (pa.array(ids.astype(self.kind)), pa.array(np.arange(len(ids)) < used))
        columns = [pa.FixedSizeListArray.from_arrays(x, self.layout.length) for x in values]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.held])
        if len(ids):
            filled = np.full(-(-len(ids) // self.layout.length) * self.layout.length, self.layout.end_id, np.uint32)
            filled[: len(ids)] = ids
            self._write(filled, len(ids))
        self.writer.close()


def _write(folder: str, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        names = [f"{root}/shard-{shard:07d}{kind}.arrow" for kind in ("", ".docs")]
        drafts = [f"{root}/.{own}{kind}" for kind in ("", ".docs")]
        encode, n_docs = encoder(layout), 0
        with files.open_output_stream(drafts[0]) as sink, files.open_output_stream(drafts[1]) as index:
            sequences, rows = _Sequences(sink, layout), pa.ipc.new_file(index, _DOCS)
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                for a, b in row_groups(offsets, GROUP_BYTES):
                    ids, sizes = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    starts = sequences.n_all + np.cumsum(sizes) - sizes
                    sequences.add(ids)
                    columns = [batch.column(0).slice(a, b - a), pa.array(starts), pa.array(sizes)]
                    rows.write_batch(pa.RecordBatch.from_arrays(columns, schema=_DOCS))
                    n_docs += b - a
            sequences.close()
            rows.close()
        give_back()
        for draft, name in zip(drafts, names, strict=True):
            files.move(draft, name)
        if n_docs:
            counts = [pa.array([x], pa.int64()) for x in (shard, n_docs, sequences.n_all)]
            yield pa.RecordBatch.from_arrays(counts, ["shard", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, layout: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and return the stored manifest (shard, n_docs, n_tokens, first_token).

    Documents go in ascending order of doc_id, nulls first, equal ids by text. A null text is empty: just
    the end id. Other columns are left out. An empty table gives an empty manifest.
    """
    folder = resolved(docs.sparkSession, folder)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(_write(folder, layout), "shard long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """Random access to one shard of a folder with its scheme; on a local file system through a memory map."""

    def __init__(self, folder: str, shard: int):
        files, root = _files(folder)
        name = f"{root}/shard-{shard:07d}"
        local = isinstance(files, pafs.LocalFileSystem)
        opened = [pa.memory_map(f"{name}{k}.arrow") if local else files.open_input_file(f"{name}{k}.arrow") for k in ("", ".docs")]
        self.sequences, self.docs = (pa.ipc.open_file(x) for x in opened)
        told = self.sequences.schema.metadata
        self.length, self.batch = int(told[b"sequence_length"]), int(told[b"sequences_per_batch"])

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of the k-th sequence."""
        batch, row = self.sequences.get_batch(k // self.batch), k % self.batch
        ids, mask = (c.values.slice(row * self.length, self.length) for c in batch.columns)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in portions, one for each batch."""
        size = self.length * self.batch
        for k in range(start // size, -(-(start + n) // size)):
            values = self.sequences.get_batch(k).column(0).values.to_numpy()
            yield values[max(0, start - k * size) : start + n - k * size]


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    folder = resolved(manifest.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files = Shard(folder, shard)
                for k in range(files.docs.num_record_batches):
                    rows = files.docs.get_batch(k)
                    starts, sizes = (rows.column(c).to_numpy() for c in (1, 2))
                    sums = []
                    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                        crc = 0
                        for ids in files.ids(start, n):
                            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
                        sums.append(crc)
                    columns = [rows.column(0), pa.array(starts + first), rows.column(2), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = manifest.select("shard", "first_token").repartition(n, "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, layout: Layout) -> DataFrame:
    """Write ``docs`` into a fresh folder below the shared one and read the digests back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_digests(write_tokens(docs, folder, layout), folder)
