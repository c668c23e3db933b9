"""The prefix trie of conversations, by van Emde Boas recursion over depth.

All conversations are cut at half of the depth (a power of two), at each half again, and so on; the parts of one
size are handled together, whatever trie they belong to.

* Contents. A block of turns is named by its halves' names, from single turns up.
* Names. The prefix at a cut is named by the prefix at the cut above and the block between, from the largest blocks
  down. So the upper trie and the lower forests, which hang from the prefixes named at the cut, get their names in as
  many rounds as the depth has bits. A name is a digest of 128 bits; equal names are one node.
* Totals. From the smallest blocks up, each tree of a lower forest hands its total to all its ancestors in the upper
  trie at once, which are as many as the upper trie is deep.

Rows are turns, cuts or nodes, never conversations, so one conversation, prefix or node may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.digests import joined_sha256
from pagemill.operators.numbering import number_rows
from pagemill.session import materialize

ROOT = bytes(16)
BLOCK = 4096


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _lowest_bit(d: Column) -> Column:
    return d.bitwiseAND(-d)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, token, bytes): role and text of a turn as a digest, and the length of its text in UTF-8.

    Turns are in order of their number, nulls first; turns of one number by role, then by the text's SHA-256. Repeated
    rows are repeated turns; a null role or text is empty; rows without conv_id belong to none.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("text_sha"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    numbered = number_rows(thin, ["conv_id"], "turn", ["role", "text_sha"], name="pos")
    return numbered.select("conv_id", "pos", _digest(F.col("text_sha"), F.col("role")).alias("token"), "bytes")


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, and their lengths: (conv_id, depth from 1, token, bytes) and (conv_id, length).

    Conversation c gets the first h turns of c - c % every (all if fewer, none if absent) in place of its own
    first h, with h = crc32(c) % heads. A conversation may be left without turns.
    """
    own = materialize(numbered_turns(turns), "turns")
    conv = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    conv = conv.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    conv = conv.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    bases = conv.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    conv = conv.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    conv = materialize(conv.select("conv_id", "base", "n", "h", "taken"), "conversations")
    lengths = conv.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    heads_of = conv.where("taken > 0").select(F.col("conv_id").alias("to"), F.col("base").alias("conv_id"), F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("pos"))
    head = heads_of.join(own, ["conv_id", "pos"]).select(F.col("to").alias("conv_id"), F.col("pos").alias("depth"), "token", "bytes")
    # in blocks of turns, so that a long conversation meets its row in many tasks
    shift = conv.where("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}"))).alias("block"))
    rest = own.withColumn("block", F.expr(f"pos div {BLOCK}")).join(shift, ["conv_id", "block"]).where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "token", "bytes")
    return materialize(head.unionByName(rest), "rebuilt"), lengths


def _contents(sequences: DataFrame, half: int) -> dict[int, DataFrame]:
    """(conv_id, at, token) of the whole blocks of each size up to ``half``; a block covers the turns at + 1 to at + size."""
    blocks = {1: sequences.select("conv_id", (F.col("depth") - 1).alias("at"), "token")}
    size = 1
    while size < half:
        pairs = blocks[size].groupBy("conv_id", (F.col("at") - F.col("at") % (2 * size)).alias("start")).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("token", "at").alias("left"), F.max_by("token", "at").alias("right")
        )
        size *= 2
        blocks[size] = materialize(pairs.where("n = 2").select("conv_id", F.col("start").alias("at"), _digest(F.col("left"), F.col("right")).alias("token")), f"blocks-{size}")
    return blocks


def _names(sequences: DataFrame, half: int) -> DataFrame:
    """(conv_id, depth, name) of each prefix but the empty one."""
    blocks, named = _contents(sequences, half), None
    size = half
    while size:
        cut = blocks[size].where((F.col("at") % (2 * size)) == 0)
        below = cut.where("at = 0").withColumn("above", F.lit(ROOT))
        if named is not None:
            above = named.select("conv_id", F.col("depth").alias("at"), F.col("name").alias("above"))
            below = below.unionByName(cut.where("at > 0").join(above, ["conv_id", "at"]))
        new = below.select("conv_id", (F.col("at") + size).alias("depth"), _digest(F.col("above"), F.col("token")).alias("name"))
        new = materialize(new, f"names-{size}")
        named = new if named is None else named.unionByName(new)
        size //= 2
    return named


def _graft(nodes: DataFrame, named: DataFrame, half: int) -> DataFrame:
    """(name, n_leaves, saved_tokens) summed over subtrees, for ``nodes`` (name, depth, conv_id, n_leaves, saved_tokens)."""
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    own = nodes.select("name", "depth", "conv_id", "n_leaves", "saved_tokens")
    given = own
    size = 1
    while size <= half:
        roots = given.where(_lowest_bit(F.col("depth")) == size)
        trees = roots.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
        up = trees.select("conv_id", "n_leaves", "saved_tokens", F.explode(F.sequence(F.col("depth") - size, F.col("depth") - 1)).alias("depth"))
        root = up.where("depth = 0").withColumn("name", F.lit(ROOT))
        met = root.unionByName(up.where("depth > 0").join(named, ["conv_id", "depth"]), allowMissingColumns=True)
        new = met.groupBy("name", "depth").agg(*sums).withColumn("conv_id", F.lit(None).cast("long"))
        given = given.unionByName(materialize(new, f"graft-{size}"))
        size *= 2
    return given.groupBy("name").agg(*sums)


def prefix_trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has (conv_id, depth from 1 without gaps, token, bytes) and ``lengths`` (conv_id, length) of all
    conversations, also those without turns; both are used many times, so pass stored tables. A node is the set of
    conversations that start alike, named by the least of them and the depth; the root has no parent. saved_tokens is
    the sum over the subtree of (n_convs - 1) * bytes; ends_sha256 digests the comma-joined ids that end at the
    node. Without conversations there are no nodes.
    """
    deepest = lengths.agg(F.max("length")).first()[0]
    half = 1 << max(0, (deepest or 1).bit_length() - 1)
    lengths = lengths.select("conv_id", F.col("length").alias("depth"))
    named = _names(sequences, half)
    found = named.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    found = found.join(sequences.select("conv_id", "depth", "bytes"), ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left")
    found = found.withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    root = root.select(F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("binary").alias("parent"))
    nodes = materialize(found.unionByName(root), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = materialize(nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie")
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # many children of one parent are split by the skew join; the result is stored before it is dealt out by name
    placed = materialize(nodes.drop("n_leaves", "saved_tokens", "bytes").join(parents, "parent", "left"), "placed")
    ends = lengths.where("depth > 0").join(named, ["conv_id", "depth"]).select("name", "conv_id")
    ends = ends.unionByName(lengths.where("depth = 0").select(F.lit(ROOT).alias("name"), "conv_id"))
    listed = ends.select(F.col("name").alias("key"), F.col("conv_id").alias("at"), F.col("conv_id").cast("string").alias("text"))
    digests = joined_sha256(listed, ",", "ends_sha256").withColumnRenamed("key", "name")
    return (
        placed.join(_graft(nodes, named, half), "name")
        .join(digests, "name", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
