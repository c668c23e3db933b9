"""Near duplicates by SuperMinHash, banding, verification on full sets and union-find.

SuperMinHash gives every element one random permutation of the slots: at rank j it offers j plus a random
fraction to its j-th slot, and a slot keeps the least offer. The ranks of one element are correlated, which
lowers the variance of the estimate. Since offers of rank j are below j + 1, the ranks can be played for all
elements together, and a document stops as soon as each of its slots has an offer: later ones are larger.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.arrow import grouped, lists, map_batches
from pagemill.llm.graph import components
from pagemill.llm.words import U, mix, shingle_sets
from pagemill.session import materialize

_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_STEP = U(0x9E3779B97F4A7C15)
_SALT = U(0x632BE59BD9B4E019)
_CELLS = 1 << 20
#: A shingle that more rows than this meet by is looked at by differences to a center.
_CROWD = 64
#: 64-bit words of the parities by which differences to a center are told apart.
_PARITIES = 8
_NAMES = [f"p{k}" for k in range(_PARITIES)]


class Plan(NamedTuple):
    """Linked if 100 * intersection >= percent * union. ``bands`` * ``rows`` slots; with these, two
    documents at the threshold share no band with a chance of 4e-7."""

    width: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4


WORDS3_85 = Plan(width=3, percent=85, bands=20, rows=4)


def signatures(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of consecutive sets of distinct 64-bit hashes; a row of 2**64-1 for an empty set."""
    n = len(sizes)
    sig = np.full(n * slots, _EMPTY, U)
    home = np.repeat(np.arange(n), sizes)
    if not len(elements):
        return sig.reshape(n, slots)

    def draw(x: np.ndarray, j: int):
        r = mix(x + U((j * int(_STEP) + int(_SALT)) & 0xFFFFFFFFFFFFFFFF))
        slot = ((r >> U(32)) * U(slots - j)) >> U(32)
        return slot.astype(np.int64) + j, (U(j) << U(32)) | (r & U(0xFFFFFFFF))

    slot, offer = draw(elements, 0)
    np.minimum.at(sig, home * slots + slot, offer)
    left = np.flatnonzero((sig.reshape(n, slots) == _EMPTY).any(1) & (sizes > 0))
    todo = np.isin(home, left) if len(left) else np.zeros(len(home), bool)
    x, home, slot = elements[todo], home[todo], slot[todo]
    order = np.tile(np.arange(slots, dtype=np.int16), (len(x), 1))
    at = np.arange(len(x))
    order[at, slot], order[:, 0] = 0, slot.astype(np.int16)
    for j in range(1, slots):
        if not len(x):
            break
        k, offer = draw(x, j)
        chosen = order[at, k]
        order[at, k] = order[:, j]
        order[:, j] = chosen
        np.minimum.at(sig, home * slots + chosen, offer)
        if j % 4 == 0 or j < 4:
            open_rows = (sig.reshape(n, slots) == _EMPTY).any(1)
            keep = open_rows[home]
            if not keep.all():
                x, home, order = x[keep], home[keep], order[keep]
                at = np.arange(len(x))
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.zeros((len(sig), bands), U)
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        keys = mix(keys * _STEP + parts[:, :, r])
    return mix(keys + np.arange(1, bands + 1, dtype=U) * _SALT)


def sketch(docs: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): set_key is a 128-bit digest of the set; an empty set has
    neither key nor bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, bands, counts = [], [], [], []
        for _, _, data, offsets in grouped(batch.column(1)):
            elements, n = shingle_sets(data, offsets, plan.width)
            sig = signatures(elements, n, plan.bands * plan.rows)
            raw, end = elements.tobytes(), (np.cumsum(n) * 8).tolist()
            keys += [
                hashlib.blake2b(raw[e - 8 * k : e], digest_size=16).digest() if k else None
                for e, k in zip(end, n.tolist(), strict=True)
            ]
            bands.append(band_keys(sig, plan.bands, plan.rows)[n > 0].ravel().view(np.int64))
            counts.append(np.where(n > 0, plan.bands, 0))
            sizes.append(n)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.concatenate(sizes)),
                pa.array(keys, pa.binary()),
                lists(np.concatenate(bands), np.concatenate(counts), pa.int64()),
            ],
            ["doc_id", "n_shingles", "set_key", "bands"],
        )

    return map_batches(
        docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")),
        run,
        "doc_id long, n_shingles long, set_key binary, bands array<long>",
    )


def shingles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the sorted set of each row as packed 64-bit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, _, data, offsets in grouped(batch.column(1)):
            elements, n = shingle_sets(data, offsets, width)
            raw, end = elements.tobytes(), (np.cumsum(n) * 8).tolist()
            out += [raw[e - 8 * k : e] for e, k in zip(end, n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, shingles binary")


def _common(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = np.zeros(batch.num_rows, np.int64)
    for k in range(batch.num_rows):
        a = np.frombuffer(batch.column(2)[k].as_buffer(), U)
        b = np.frombuffer(batch.column(3)[k].as_buffer(), U)
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        n[k] = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
    sizes = [pa.array(np.array([len(x.as_buffer()) // 8 for x in batch.column(c)], np.int64)) for c in (2, 3)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *sizes], ["a", "b", "common", "n_a", "n_b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    counted = map_batches(joined, _common, "a long, b long, common long, n_a long, n_b long")
    return counted.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def least_shared(size: int, length: int, center: int, near: bool, percent: int) -> int:
    """The fewest elements that a set's difference to a center has in common with that of any set it is linked to.

    The set has ``size`` elements, its difference ``length``, the center ``center``; ``near``: it is linked to the center,
    and the other one is not. Linked sets of a and b elements differ in at most (100 - percent) * (a + b) / (100 + percent).
    """
    linked, apart = 100 + percent, 100 - percent
    other = np.arange(-(-size * percent // 100), size * 100 // percent + 1)
    least = np.maximum(abs(other - center), apart * (other + center) // linked + 1 if near else length - apart * (size + other) // linked)
    return max(1, int((-(-(linked * (length + least) - apart * (size + other)) // (2 * linked))).min()))


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(a, root, size, length, near, token, left) of rows (a, root, size, center, near, elements[, p0, p1, ...]): the elements among
    which a row and any it is linked to have a common one, rare ones first; ``left``: elements from there on. Parities stay.

    Frequency comes from a table of fixed size by hash; any order gives the same links, this one gives few candidates.
    """

    def tally(batches):
        cells = np.zeros(_CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                cells += np.bincount((np.frombuffer(x.as_buffer(), U) % U(_CELLS)).astype(np.int64), minlength=_CELLS)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    table = np.zeros(_CELLS, np.int64)
    counted = rows.select("elements").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in counted.where("n > 1").toLocalIterator():
        table[r.cell] = r.n
    table = table.clip(0, 2**31 - 1).astype(np.int32)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, lefts, lengths, kept = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
        for size, center, near, x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), batch.column(5), strict=True):
            own = np.frombuffer(x.as_buffer(), U)
            keep = max(0, len(own) - least_shared(size, len(own), center, near, percent) + 1)
            order = np.lexsort((own, table[(own % U(_CELLS)).astype(np.int64)]))[:keep]
            tokens.append(own[order].view(np.int64))
            lefts.append(len(own) - np.arange(len(order)))
            lengths.append(len(own))
            kept.append(len(order))
        a, root, size, near, *more = (pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), kept)) for c in (0, 1, 2, 4, *range(6, batch.num_columns)))
        length = pa.array(np.repeat(np.array(lengths, np.int64), kept))
        return pa.RecordBatch.from_arrays(
            [a, root, size, length, near, pa.array(np.concatenate(tokens)), pa.array(np.concatenate(lefts)), *more],
            ["a", "root", "size", "length", "near", "token", "left", *parities],
        )

    parities = [c for c in rows.columns if c in _NAMES]
    rows = rows.select("a", "root", "size", "center", "near", "elements", *parities)
    schema = "a long, root long, size long, length long, near boolean, token long, left long"
    return map_batches(rows, run, ", ".join([schema, *(f"{c} long" for c in parities)]))


def differences(listed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, root, size, center, near, elements, b, root_b, p0, p1, ...) of rows (a, b): the elements that are in only one of the sets
    of a and of its center b, hashed with b, so those of one center alone can be equal; ``center``: size of b's set.
    The parities have a bit for each hash of elements, set if an odd number of them has it: two sets differ in at least as
    many elements as their parities do in bits."""
    own = sets.select(F.col("doc_id").alias("a"), "root", F.col("shingles").alias("own"))
    centers = sets.join(listed.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    centers = materialize(centers.select(F.col("doc_id").alias("b"), F.col("root").alias("root_b"), F.col("shingles").alias("other")), "centers")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, others, near, out, bits = [], [], [], [], []
        for b, x, y in zip(batch.column(2).to_numpy(), batch.column(4), batch.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            apart = np.setxor1d(x, y, assume_unique=True)
            sizes.append(len(x))
            others.append(len(y))
            near.append((100 + percent) * len(apart) <= (100 - percent) * (len(x) + len(y)))
            apart = mix(apart + mix(np.array([b]).view(U) + _STEP))
            out.append(apart.tobytes())
            odd = np.bincount((apart % U(64 * _PARITIES)).astype(np.int64), minlength=64 * _PARITIES) & 1
            bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        made = [pa.array(sizes, pa.int64()), pa.array(others, pa.int64()), pa.array(near, pa.bool_()), pa.array(out, pa.binary())]
        columns = [batch.column(0), batch.column(1), *made, batch.column(2), batch.column(3), *map(pa.array, np.stack(bits, 1))]
        return pa.RecordBatch.from_arrays(columns, ["a", "root", "size", "center", "near", "elements", "b", "root_b", *_NAMES])

    joined = listed.join(own, "a").join(centers, "b").select("a", "root", "b", "root_b", "own", "other")
    schema = "a long, root long, size long, center long, near boolean, elements binary, b long, root_b long"
    return map_batches(joined, run, ", ".join([schema, *(f"{c} long" for c in _NAMES)]))


def meeting(rows: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of :func:`prefixes` with one of ``tokens`` in common, with different roots, not both near, with
    enough elements left from there on, and with parities that don't differ in too many bits."""
    rows = rows.join(tokens.select("token"), "token")
    parities = [c for c in rows.columns if c in _NAMES]
    other = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("a", "root", "size", "length", "near", "left", *parities)])
    room = 2 * (100 + percent) * F.least("left", "left_b")
    needed = (100 + percent) * (F.col("length") + F.col("length_b")) - (100 - percent) * (F.col("size") + F.col("size_b"))
    once = F.col("near_b") | (F.col("a") > F.col("a_b"))
    fits = once & (F.col("root") != F.col("root_b")) & (room >= needed)
    if parities:
        differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in parities), F.lit(0))
        fits = fits & ((100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col("size_b")))
    met = rows.where(~F.col("near")).join(other, "token").where(fits)
    return met.select(F.greatest("a", "a_b").alias("a"), F.least("a", "a_b").alias("b"))


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (doc_id, root, shingles) with different roots, among them enough to link all that reach the
    similarity; found by prefix filtering, so unlike ones cost nothing.

    All sets are put in one order of shingles, rare ones first. Two sets that reach the similarity have a
    common shingle among the first ``size - ceil(size * percent / 100) + 1`` of each, and behind the first
    such one enough room for the rest.

    Near copies share frequent shingles too, and all their pairs would meet. So a shingle in more than ``_CROWD`` rows gets
    a center, the row with most shingles from there on, and its rows are compared by their differences to the center:
    two sets differ in what their differences don't share. Rows linked to the center are paired with it alone. Of
    any other two at least one is not linked to it; if they are linked to each other, their differences share an element, and
    mostly many: they are found by prefix filtering once more. What copies have in common is in no difference. Parities
    of the differences keep apart what is plainly unlike.
    """
    whole = sets.where(F.length("shingles") > 0)
    size = (F.length("shingles") / 8).cast("long").alias("size")
    rows = whole.select(F.col("doc_id").alias("a"), "root", size, F.lit(0).cast("long").alias("center"), F.lit(False).alias("near"), F.col("shingles").alias("elements"))
    rows = materialize(prefixes(rows, percent), "prefixes")
    fullest = F.min(F.struct((-F.col("left")).alias("left"), "a")).alias("fullest")
    shared = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), fullest)
    shared = materialize(shared.where("lo < hi").select("token", "n", F.col("fullest.a").alias("b")), "shared")
    found = meeting(rows, shared.where(F.col("n") <= _CROWD), percent)
    crowds = shared.where(F.col("n") > _CROWD)
    if not crowds.isEmpty():
        listed = materialize(rows.join(crowds, "token").select("a", "b").distinct(), "crowds")
        apart = materialize(differences(listed, whole, percent), "differences")
        central = apart.where(F.col("near") & (F.col("root") != F.col("root_b")))
        found = found.unionByName(central.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        rows = materialize(prefixes(apart, percent), "prefixes-apart")
        some = F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("near").alias("near")
        found = found.unionByName(meeting(rows, rows.groupBy("token").agg(*some).where("lo < hi and not near"), percent))
    return found.distinct()


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    1. Rows with one and the same set become one class, under its least id: copies cost no pairs.
    2. Classes that share a band form a bucket. Each member is paired with the bucket's least member.
    3. Pairs of sizes that can reach the similarity are verified on full sets; links form components.
    4. Buckets that still hold several components may hide a link that does not touch their least member.
       Among the members of all such buckets, prefix filtering finds pairs across components that can reach the
       similarity, all but those whose two members are linked to a third; they are verified too. So no link that
       banding found is lost, and no bucket is expanded into all its pairs.

    A null or blank text has an empty set and is linked with nothing; a null id is never linked and kept.
    Rows that repeat an id count as one document, with the links of all of them.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(sketch(named, plan), "sketches")
    classes = materialize(
        rows.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")),
        "classes",
    )
    members = classes.select("rep", "size", F.explode("bands").alias("band"))
    centers = members.groupBy("band").agg(F.min(F.struct("rep", "size")).alias("c"), F.count("*").alias("n")).where("n > 1")
    small, big = F.least("size", "size_b"), F.greatest("size", "size_b")
    fits = 100 * small >= plan.percent * big
    buckets = members.join(centers, "band").select("band", "rep", "size", F.col("c.rep").alias("b"), F.col("c.size").alias("size_b"))
    pairs = materialize(
        buckets.where(fits & (F.col("rep") > F.col("b"))).groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("shared")),
        "pairs",
    )
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(
        shingles(named.join(involved, "doc_id", "left_semi"), plan.width).dropDuplicates(["doc_id", "shingles"]), "sets"
    )
    links = materialize(verified(pairs.select("a", "b"), sets, plan.percent), "links")
    roots = materialize(components(links), "roots")
    root = F.coalesce("root", "rep").alias("root")
    placed = buckets.select("band", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", root)
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = placed.join(split, "band").select(F.col("rep").alias("doc_id"), "root").distinct()
    across = prefix_pairs(materialize(rest.join(sets, "doc_id"), "split-sets"), plan.percent)
    across = across.join(pairs, ["a", "b"], "left_anti")
    more = materialize(verified(across, sets, plan.percent), "more-links")
    if more.take(1):
        roots = materialize(components(links.unionByName(more)), "roots")
    placed = classes.select("set_key", F.col("rep").alias("node")).join(roots, "node", "left")
    placed = placed.select("set_key", F.coalesce("root", "node").alias("component"))
    result = rows.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
