"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key with its quality weight as rate; the least keys are a weighted sample
without replacement. A source whose target is beyond its size takes complete epochs first; the rest of the
budget is filled with documents in the order of their keys, until the prefix sum of sizes reaches it. The
document at the limit is taken in part: its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]"
WEIGHTS = (3, 1, 2)
MOST = 2.0
SHARE = 1.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1, less the more of the characters ``#*$%&|<>`` the text has."""
    symbols = F.length(F.regexp_replace(text, SYMBOL, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 5 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(0.05))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the id alone, so that reruns agree."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size).

    Weights repeat over the sources in code point order, null last. ``share`` times all sizes is dealt by
    weight; no target is above ``most`` times its source's size, and the excess is dealt again. That is, targets
    are min(weight * level, most * size) for the one level that spends it all. Sources are a table of
    a row each; the windows over them hold names and three numbers.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("top", most * F.col("source_size"))
    full = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent, used = F.coalesce(F.sum("top").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = share * F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - spent) / (F.sum("weight").over(everything) - used))
    # the first source, in order of fullness, that the level of those from it on doesn't fill
    rows = rows.withColumn("place", F.row_number().over(full))
    open_level = F.when(F.col("level") <= F.col("top") / F.col("weight"), F.struct("place", "level"))
    rows = rows.withColumn("final", F.min(open_level).over(everything)["level"])
    return rows.select("source", "source_size", F.least(F.col("weight") * F.col("final"), F.col("top")).alias("target"))


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, content, size, source_size, target, copies, part, taken) of each row of ``docs``.

    ``copies`` whole repeats and the first ``part`` words are taken; ``taken`` is their sum in words, ``content``
    a hash of text and source that tells rows with one id apart. A null text has size 0 and is taken in
    whole copies only; a null source is a source of its own; null or repeated ids share a key and are
    ordered by size and content. A size of 0 has no words to take.

    The prefix sum goes over ranges of (source, key) that Spark balances by sampling: sums within a range, and
    offsets from the ranges' sums, so a source of a third of all rows is no single task.
    """
    q = quality if quality is not None else quality_weight(F.col(text))
    thin = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        (-F.log(uniform(F.col(doc_id))) / q).alias("key"),
        F.xxhash64(F.col(text), F.col(source)).alias("content"),
    )
    order = ["key", "doc_id", "size", "content"]
    ranged = thin.repartitionByRange("source", *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "keys")
    parts = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    goals = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    parts = parts.select(F.col("source").alias("s"), F.col("range").alias("r"), "offset")
    goals = goals.withColumnRenamed("source", "g")
    plan = parts.join(goals, F.col("s").eqNullSafe(F.col("g"))).drop("g", "n")
    rows = ranged.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    own = Window.partitionBy("range", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    room = F.greatest(F.least(F.col("budget") - F.col("before"), F.col("size")), F.lit(0))
    copies = (F.col("epochs") + F.when((room == F.col("size")) & (F.col("before") < F.col("budget")), 1).otherwise(0)).cast("long")
    rows = rows.withColumn("copies", copies)
    part = F.when(F.col("copies") > F.col("epochs"), 0).otherwise(room).cast("long")
    rows = rows.withColumn("part", part)
    taken = (F.col("copies") * F.col("size") + F.col("part")).alias("taken")
    return rows.select("doc_id", "content", "size", "source_size", "target", "copies", "part", taken)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, whatever their names; the row at a
    budget's limit has only its first words, with the white space between them.

    Nulls and sizes of 0 are as in :func:`mix`. Rows that share id and content with another take turns at their copies, in an
    order of their own; only these are numbered, all others meet their copies by id and content alone.
    """
    plan = mix(docs, **options).select(F.col("doc_id").alias("id"), "content", "copies", "part")
    same = Window.partitionBy("id", "content")
    plan = plan.withColumn("nth", F.row_number().over(same.orderBy(F.desc("copies"), F.desc("part")))).withColumn("n", F.count(F.lit(1)).over(same))
    plan = plan.select(F.col("id").alias("to"), F.col("content").alias("said"), "nth", "n", "copies", "part").where("copies > 0 or part > 0")
    plan = materialize(plan, "copies")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", "source").alias("content"), whole)
    key = F.col("id").eqNullSafe(F.col("to")) & (F.col("content") == F.col("said"))
    alone = rows.join(plan.where("n = 1"), key).select("row", "copies", "part")
    several = plan.where("n > 1")
    if several.isEmpty():
        return _taken(docs, alone)
    among = rows.join(several.select("to", "said").distinct(), key, "left_semi")
    among = among.withColumn("place", F.row_number().over(Window.partitionBy("id", "content").orderBy(F.xxhash64("row"))))
    met = among.join(several, key & (F.col("place") == F.col("nth"))).select("row", "copies", "part")
    return _taken(docs, alone.unionByName(met))


def _taken(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (row, copies, part) as often as they are taken, with the columns of ``docs``."""
    total = (F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    each = rows.select("row", "copies", "part", F.explode(F.sequence(F.lit(0), total - 1)).alias("copy"))
    text = F.col("row")["text"]
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(F.col("copy") < F.col("copies"), text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), ""))
    return each.select(*[(cut if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
