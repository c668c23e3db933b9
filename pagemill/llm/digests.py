"""SHA-256 of long lists of texts that lie in many rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.arrow import forget
from pagemill.session import materialize

ROWS, CHARS = 4096, 1 << 20


def joined_sha256(rows: DataFrame, separator: str, name: str = "sha256") -> DataFrame:
    """(key, ``name``) for ``rows`` (key, at, text): the hex digest of each key's texts in the order of ``at``, joined.

    Rows are sorted over ranges of (key, at), so those of one key lie in many tasks, each of which joins neighbours to
    texts of at most ``ROWS`` rows and about ``CHARS`` characters. Only these are brought together by key, and they
    go through the digest one after another: a key's list is never held. A null key, at or text is not expected.
    """
    stored = materialize(rows.select("key", "at", "text"), "texts")
    kinds = {f.name: to_arrow_type(f.dataType) for f in stored.schema}
    types = {f.name: f.dataType.simpleString() for f in stored.schema}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys, places, texts = (c.to_pylist() for c in batch.columns)
            out, start, size = [], 0, 0
            for k in range(1, len(keys) + 1):
                size += len(texts[k - 1])
                if k == len(keys) or keys[k] != keys[start] or k - start == ROWS or size > CHARS:
                    out.append((keys[start], places[start], separator.join(texts[start:k])))
                    start, size = k, 0
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, state = None, hashlib.sha256()

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([f[0] for f in found], kinds["key"]), pa.array([f[1] for f in found], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["key", name])

        for batch in batches:
            found = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        found.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(text.encode())
                else:
                    state.update((separator + text).encode())
            yield out(found)
        if key is not None:
            yield out([(key, state.hexdigest())])

    ranged = stored.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    texts = ranged.mapInArrow(join, ", ".join(f"{k} {t}" for k, t in types.items()))
    dealt = texts.repartition("key").sortWithinPartitions("key", "at").select("key", "text")
    return dealt.mapInArrow(digest, f"key {types['key']}, {name} string")
