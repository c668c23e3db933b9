"""The registered queries of the operators, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (
    chat,
    classifier,
    conversation_repair,
    conversation_trie,
    decontaminate,
    html_extract,
    mixing,
    near_dedup,
    quality,
    suffix_dedup,
    token_counts,
    token_output,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
CONTROL = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), token_output.Layout(tokenizer_path()))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.WORDS3_85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"))
    role = F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role")
    return chat.digests(chat.chat_windows(turns.unionByName(one.select("conv_id", "turn", role, F.lit(CONTROL).alias("text")))))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(turns), turns).report


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extract,
        op2_quality_rules,
        op3_mixing,
        op4_suffix_dedup,
        op5_token_output,
        op6_near_dedup,
        op7_url_filter,
        op8_decontaminate,
        op9_classifier,
        op10_chat,
        op11_conversation_repair,
        op12_token_counts,
        op13_conversation_trie,
        pipeline,
    )
}

# Sources weigh 3, 1, 2 in code point order (DuckDB's default order of strings is that of bytes). The level of the
# water line is the first, in order of fullness, that its own source and all later ones don't fill.
_MIXING = r"""
with d as (
  select doc_id, source, text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    coalesce(greatest(0.05::double, 1::double - 5 * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::double
      / greatest(length(text), 1)), 0.05::double) as quality,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
    [3.0::double, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from d group by source),
f as (
  select *, row_number() over (order by 2.0::double * source_size / w, source nulls last) as place,
    1.5::double * sum(source_size) over () as total, sum(w) over () as all_w from s),
g as (
  select *, coalesce(sum(2.0::double * source_size) over (order by place rows between unbounded preceding and 1 preceding), 0) as spent,
    coalesce(sum(w) over (order by place rows between unbounded preceding and 1 preceding), 0) as used from f),
h as (select *, (total - spent) / (all_w - used) as level from g),
l as (select min_by(level, place) as level from h where level <= 2.0::double * source_size / w),
t as (
  select h.source, source_size, least(w * l.level, 2.0::double * source_size) as target from h left join l on true),
e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
k as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::bigint as budget,
    coalesce(sum(d.size) over (partition by d.source order by -ln(d.u) / d.quality, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0) as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target,
  (epochs * size + greatest(least(budget - before, size), 0))::bigint as taken from k
"""

# A prefix is the list of its turns; every node counts for all prefixes of its own list.
_TRIE = r"""
with own as (
  select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
conv as (
  select conv_id, list(t order by pos) as turns,
    list_reduce(list_concat([4294967295::hugeint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::hugeint)),
      lambda c, b: list_reduce(list_concat([xor(c::bigint, b::bigint)::hugeint], [0::hugeint, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: xor((x::bigint >> 1), 3988292384 * (x::bigint & 1))::hugeint)) as crc
  from own group by conv_id),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from (select *, (xor(crc::bigint, 4294967295) % 9)::bigint as h from conv) c left join conv b on b.conv_id = c.conv_id - c.conv_id % 5),
members as (
  select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from rebuilt),
nodes as (
  select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = depth), '')) as ends_sha256
  from members group by all),
kids as (
  select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
placed as (
  select n.*, coalesce(k.n_children, 0) as n_children, p.conv_id as parent_conv_id,
    case when n.depth = 0 then 0 else (n.n_convs - 1) * strlen(n.path[n.depth].text) end as saved
  from nodes n left join kids k on n.path = k.path left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]),
spread as (
  select saved, n_children, path, unnest(range(0, depth + 1)) as d from placed),
totals as (
  select path[1:d] as path, sum(saved)::bigint as saved_tokens, (count(*) filter (n_children = 0))::bigint as n_leaves from spread group by 1)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from placed join totals using (path)
"""

ORACLE: dict[str, str] = {"op3_mixing": _MIXING, "op13_conversation_trie": _TRIE}
