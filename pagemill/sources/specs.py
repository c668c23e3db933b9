"""Crawl specifications: JSON to a typed table, overlays, and one specification as plan parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.language import DEFAULT_LANGUAGES
from pagemill.operators.paragraphs import DEFAULT_RAW_TYPES, DEFAULT_XPATHS

_STRINGS = T.ArrayType(T.StringType())
PARSER_DATA_SCHEMA = T.StructType(
    [
        T.StructField("allowed_languages", _STRINGS),
        T.StructField("keep_langdetect_errors", T.BooleanType()),
        T.StructField("xpaths", _STRINGS),
        T.StructField("allowed_content_type", _STRINGS),
    ]
)
SPEC_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("logs", T.StringType()),
        T.StructField("urls", _STRINGS),
        T.StructField("blacklist", _STRINGS),
        T.StructField("whitelist", _STRINGS),
        T.StructField("parser", T.StringType()),
        T.StructField("parser_data", PARSER_DATA_SCHEMA),
        T.StructField("pipelines", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField(
            "finalizers", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
        ),
    ]
)
TEXT_FIELDS = ("name", "output", "logs", "parser")
LIST_FIELDS = ("urls", "blacklist", "whitelist")
MAP_FIELDS = ("pipelines", "finalizers")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parser_defaults(data: Column) -> Column:
    """Parser data with the parsers' defaults for what is missing."""
    defaults = {
        "allowed_languages": _strings(DEFAULT_LANGUAGES),
        "keep_langdetect_errors": F.lit(True),
        "xpaths": _strings(DEFAULT_XPATHS),
        "allowed_content_type": _strings(DEFAULT_RAW_TYPES),
    }
    return F.struct(*[F.coalesce(data[f], d).alias(f) for f, d in defaults.items()])


def with_defaults(specs: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Missing lists and maps become empty, missing parser data takes the parsers' defaults. ``others`` stay as they are."""
    empty_list = F.array().cast("array<string>")
    empty_map = {f: F.create_map().cast(SPEC_SCHEMA[f].dataType) for f in MAP_FIELDS}
    data = F.col("parser_data")
    return specs.select(
        *others,
        *TEXT_FIELDS[:3],
        *[F.coalesce(f, empty_list).alias(f) for f in LIST_FIELDS],
        "parser",
        parser_defaults(data).alias("parser_data"),
        *[F.coalesce(f, empty_map[f]).alias(f) for f in MAP_FIELDS],
    )


def parse_patches(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON text column to specification columns as they are, absent ones NULL, for :func:`overlay_specs`."""
    return bodies.select(F.from_json(body, SPEC_SCHEMA).alias("s")).select("s.*")


@dataclass(frozen=True)
class SplitSpecs:
    """``accepted``: other columns and the specification's, with defaults; ``rejected``: other columns, body, reason."""

    accepted: DataFrame
    rejected: DataFrame


def split_specs(bodies: DataFrame, body: str = "body") -> SplitSpecs:
    """JSON text column to specifications, apart from what is none: an empty text, not JSON, no object, with a field
    of another type than it should have, or without a name. So nothing unreadable becomes an empty crawl."""
    others = [c for c in bodies.columns if c != body]
    told = T.StructType([*SPEC_SCHEMA, T.StructField("_corrupt", T.StringType())])
    parsed = bodies.select(
        *others,
        F.col(body).alias("_body"),
        F.from_json(body, told, {"columnNameOfCorruptRecord": "_corrupt"}).alias("_spec"),
        F.schema_of_variant(F.try_parse_json(body)).alias("_kind"),
    )
    reason = (
        F.when(F.coalesce(F.trim("_body"), F.lit("")) == "", "empty")
        .when(F.col("_kind").isNull(), "not JSON")
        .when(~F.col("_kind").startswith("OBJECT"), "not an object")
        .when(F.col("_spec._corrupt").isNotNull(), "field of another type")
        .when(F.coalesce("_spec.name", F.lit("")) == "", "no name")
    )
    judged = parsed.withColumn("_reason", reason)
    good = judged.where("_reason is null").select(*others, *[F.col(f"_spec.{f}").alias(f) for f in SPEC_SCHEMA.names])
    bad = judged.where("_reason is not null").select(*others, F.col("_body").alias(body), F.col("_reason").alias("reason"))
    return SplitSpecs(with_defaults(good, others), bad)


def parse_specs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The readable specifications of a JSON text column, with defaults; other columns are dropped."""
    return split_specs(bodies.select(body), body).accepted


def split_spec_files(spark: SparkSession, path: str) -> SplitSpecs:
    """Specification files, one JSON object per file, with the ``file`` of each."""
    texts = spark.read.text(path, wholetext=True)
    return split_specs(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """The readable specification files."""
    return split_spec_files(spark, path).accepted.drop("file")


def overlay_specs(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Lay ``patch`` (from :func:`parse_patches`, without defaults) over ``base`` by name; a patch field wins
    only if it is not empty. Parser data with any field in it replaces that of the base as a whole."""
    b, p = base.alias("b"), patch.alias("p")
    data = F.col("p.parser_data")
    told = F.coalesce(reduce(or_, [data[f].isNotNull() for f in PARSER_DATA_SCHEMA.names]), F.lit(False))

    def pick(name: str, wins: Column) -> Column:
        return F.when(wins, F.col(f"p.{name}")).otherwise(F.col(f"b.{name}")).alias(name)

    def filled(name: str) -> Column:
        return F.coalesce(F.size(f"p.{name}") > 0, F.lit(False))

    return b.join(p, F.col("b.name") == F.col("p.name"), "left").select(
        F.col("b.name").alias("name"),
        *[pick(f, F.coalesce(F.col(f"p.{f}") != "", F.lit(False))) for f in ("output", "logs")],
        *[pick(f, filled(f)) for f in LIST_FIELDS],
        pick("parser", F.coalesce(F.col("p.parser") != "", F.lit(False))),
        F.when(told, parser_defaults(data)).otherwise(F.col("b.parser_data")).alias("parser_data"),
        *[pick(f, filled(f)) for f in MAP_FIELDS],
    )


@dataclass(frozen=True)
class CrawlSpec:
    """One specification as parameters of a plan."""

    name: str
    urls: Sequence[str] = ()
    output: str | None = None
    logs: str | None = None
    blacklist: Sequence[str] = ()
    whitelist: Sequence[str] = ()
    parser: str | None = None
    allowed_languages: Sequence[str] = DEFAULT_LANGUAGES
    keep_langdetect_errors: bool = True
    xpaths: Sequence[str] = DEFAULT_XPATHS
    allowed_content_type: Sequence[str] = DEFAULT_RAW_TYPES
    pipelines: Mapping[str, int] = field(default_factory=dict)
    finalizers: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def load_spec(spark: SparkSession, text_or_path: str) -> CrawlSpec:
    """One specification from JSON text, or else from a file. Anything but exactly one readable
    specification is refused."""
    if text_or_path.lstrip().startswith("{"):
        json.loads(text_or_path)
        rows = parse_specs(spark.range(1).select(F.lit(text_or_path).alias("body")))
    else:
        reader = spark.read.schema(SPEC_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
        rows = with_defaults(reader.json(text_or_path))
    found = rows.take(2)
    if len(found) != 1:
        raise ValueError(f"{text_or_path!r} holds {'no' if not found else 'more than one'} specification")
    fields = found[0].asDict(recursive=True)
    return CrawlSpec(**{**{k: v for k, v in fields.items() if k != "parser_data"}, **fields["parser_data"]})
