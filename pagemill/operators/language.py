"""Language scoring with trigram profiles trained by Spark.

A profile gives each kept trigram one integer log weight per language. The score of a text is the sum
over its trigrams, so it does not depend on row order. A profile that is small enough goes to all tasks,
which look the trigrams of a batch of texts up at once, and what is shuffled is one small row of sums per
text. Otherwise, and where a bucketed table must keep its partitions, which Spark's Python functions do
not, trigrams are exploded, joined to the profile and summed by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.grams import characters, count_grams, explode_grams, gram_weigher, letters_only, trigram_parts
from pagemill.operators.paragraphs import explode_structs
from pagemill.session import materialize

# The two special entries of allowed_languages, and the defaults.
ANY = "any"
DISABLED = "disabled"
DEFAULT_LANGUAGES = ("de", "en")
# Text stored for an undetectable paragraph; thresholds of the language list.
NO_FEATURES = "No features in text."
MIN_PROBABILITY = 0.1
ACCEPT_ABOVE = 0.5

WEIGHT_SCALE = 1_000_000
TOP_GRAMS = 1000
TOP_GRAM_SALTS = 64
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class LanguageModel:
    """``profile``: gram and one ``w_<language>`` bigint column per language; ``grams``: its counted rows."""

    profile: DataFrame
    languages: tuple[str, ...]
    grams: int
    broadcast_limit: int = BROADCAST_LIMIT_BYTES

    def weight_columns(self) -> list[str]:
        return [f"w_{lang}" for lang in self.languages]

    def broadcastable(self) -> bool:
        """Are the counted rows few enough to send to every task?"""
        row = 64 + 8 * len(self.languages)
        return self.grams * row <= self.broadcast_limit


def top_grams(counts: DataFrame, k: int = TOP_GRAMS, salts: int = TOP_GRAM_SALTS) -> DataFrame:
    """The ``k`` most frequent grams of each language, ties by gram.

    A language is a hot group, so the rank is taken twice: within salted slices of a language, then
    among the at most ``salts * k`` survivors.
    """
    order = [F.col("cnt").desc(), F.col("gram")]
    sliced = counts.withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(salts)))
    local = Window.partitionBy("lang", "_salt").orderBy(*order)
    survivors = sliced.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= k)
    whole = Window.partitionBy("lang").orderBy(*order)
    return (
        survivors.withColumn("_rn", F.row_number().over(whole))
        .filter(F.col("_rn") <= k)
        .drop("_rn", "_salt")
    )


def gram_counts(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return count_grams(documents.withColumn("lang", F.col(lang)), "lang", text)


def train(
    documents: DataFrame,
    languages: Sequence[str],
    text: str = "text",
    lang: str = "lang",
    top_k: int | None = None,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> LanguageModel:
    """Count all grams and weigh them; with ``top_k``, only those among the most frequent of a
    language. The counts are written once to the shared folder; only one total per language reaches
    the driver."""
    languages = tuple(sorted(languages))
    known = documents.filter(F.col(lang).isin(*languages))
    counts = materialize(gram_counts(known, text, lang), "gram-counts")
    totals = dict(counts.groupBy("lang").agg(F.sum("cnt")).collect())
    used = counts
    if top_k is not None:
        used = counts.join(top_grams(counts, top_k).select("gram").distinct(), "gram", "left_semi")
    dense = used.groupBy("gram").pivot("lang", list(languages)).agg(F.sum("cnt"))
    profile_counts = materialize(dense, "profile-counts")
    vocabulary = profile_counts.count()
    weights = [
        F.round(
            WEIGHT_SCALE
            * F.log(
                (F.coalesce(F.col(language), F.lit(0)) + 1)
                / F.lit(float(totals.get(language, 0) + vocabulary))
            )
        )
        .cast("long")
        .alias(f"w_{language}")
        for language in languages
    ]
    profile = profile_counts.select("gram", *weights)
    return LanguageModel(profile, languages, vocabulary, broadcast_limit)


def save_model(model: LanguageModel, path: str) -> None:
    model.profile.write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> LanguageModel:
    """A stored profile; its rows are counted, since they decide whether it may be broadcast."""
    profile = spark.read.parquet(path)
    languages = tuple(c[2:] for c in profile.columns if c.startswith("w_"))
    return LanguageModel(profile, languages, profile.count())


def profile_rows(model: LanguageModel) -> DataFrame:
    """The profile in long form: lang, gram, weight."""
    entries = F.array(
        *[
            F.struct(F.lit(lang).alias("lang"), F.col(f"w_{lang}").alias("weight"))
            for lang in model.languages
        ]
    )
    return model.profile.select("gram", F.inline(entries)).select("lang", "gram", "weight")


def weigh_texts(units: DataFrame, keys: Sequence[str], model: LanguageModel, letters: Column, inside: Column) -> DataFrame:
    """Sum the weights of the trigrams of ``letters`` by key: ``s_<language>`` of all, ``i_<language>`` of those within
    ``inside`` characters; NULL for keys without a trigram of the profile, which must be broadcastable."""
    stored = model.profile.where(F.length("gram") == 3).select("gram", *model.weight_columns()).toArrow()
    weights = np.stack([stored.column(c).to_numpy() for c in model.weight_columns()], 1)
    fn = gram_weigher(stored.column("gram").to_pylist(), weights)
    weighed = units.select(*keys, fn(letters, inside).alias("_w"))
    known = F.get("_w", F.lit(0)) > 0
    sums = [
        F.sum(F.when(known, F.get("_w", F.lit(1 + k)))).alias(name)
        for k, name in enumerate(f"{n}_{lang}" for n in ("s", "i") for lang in model.languages)
    ]
    return weighed.groupBy(*keys).agg(*sums)


def weigh(
    grams: DataFrame,
    keys: Sequence[str],
    model: LanguageModel,
    multiples: dict[str, Column],
    how: str = "inner",
) -> DataFrame:
    """Sum the weights of the grams of each key: columns ``<name>_<language>`` for each multiple.

    A profile whose size bound allows it is broadcast. A larger one is shuffled by gram, after the
    grams of each key have been counted, which takes the heat out of frequent grams.
    """
    keys = list(keys)
    names = list(multiples)
    tagged = grams.select(*keys, "gram", *[m.alias(f"_m_{n}") for n, m in multiples.items()])
    profile = model.profile
    if model.broadcastable():
        profile = F.broadcast(profile)
    else:
        tagged = tagged.groupBy(*keys, "gram").agg(
            *[F.sum(f"_m_{n}").alias(f"_m_{n}") for n in names]
        )
    return (
        tagged.join(profile, "gram", how)
        .groupBy(*keys)
        .agg(
            *[
                F.sum(F.col(f"w_{lang}") * F.col(f"_m_{n}")).alias(f"{n}_{lang}")
                for n in names
                for lang in model.languages
            ]
        )
    )


def score_texts(texts: DataFrame, keys: Sequence[str], text: str, model: LanguageModel) -> DataFrame:
    """Columns ``s_<language>`` per key; keys whose text has no kept gram are absent."""
    if not model.broadcastable():
        return weigh(explode_grams(texts, list(keys), text), keys, model, {"s": F.lit(1)})
    thin = texts.select(*keys, letters_only(F.col(text)).alias("_letters"))
    scores = weigh_texts(thin, keys, model, F.col("_letters"), F.lit(0))
    names = [f"s_{lang}" for lang in model.languages]
    return scores.select(*keys, *names).filter(F.col(names[0]).isNotNull())


def top_language(model: LanguageModel, prefix: str = "s") -> Column:
    """Language with the greatest score, ties to the later code; NULL without scores."""
    best = F.greatest(
        *[F.struct(F.col(f"{prefix}_{x}").alias("s"), F.lit(x).alias("l")) for x in model.languages]
    )
    return F.when(F.col(f"{prefix}_{model.languages[0]}").isNotNull(), best["l"])


def language_list(model: LanguageModel, prefix: str = "s") -> Column:
    """Array of (lang, prob), most probable first, improbable languages cut; NULL without scores."""
    scores = [F.col(f"{prefix}_{lang}") for lang in model.languages]
    best = F.greatest(*scores)
    odds = [F.exp((s - best) / float(WEIGHT_SCALE)) for s in scores]
    total = sum(odds[1:], odds[0])
    entries = F.array(
        *[
            F.struct((-F.round(o / total, 4)).alias("neg"), F.lit(lang).alias("lang"))
            for o, lang in zip(odds, model.languages)
        ]
    )
    likely = F.filter(F.array_sort(entries), lambda e: e["neg"] <= -MIN_PROBABILITY)
    named = F.transform(likely, lambda e: F.struct(e["lang"].alias("lang"), (-e["neg"]).alias("prob")))
    return F.when(scores[0].isNotNull(), named)


def format_lang_list(langs: Column) -> Column:
    """``[en:0.99, de:0.01]``"""
    entries = F.transform(langs, lambda e: F.concat(e["lang"], F.lit(":"), e["prob"].cast("string")))
    return F.concat(F.lit("["), F.array_join(entries, ", "), F.lit("]"))


def detect_texts(texts: DataFrame, keys: Sequence[str], text: str, model: LanguageModel) -> DataFrame:
    """Best language per key, the error text where there is none."""
    scored = score_texts(texts, keys, text, model).select(*keys, top_language(model).alias("_top"))
    return (
        texts.join(scored, list(keys), "left")
        .withColumn("par_language", F.coalesce("_top", F.lit(NO_FEATURES)))
        .drop("_top")
    )


def _unit_grams(units: DataFrame) -> DataFrame:
    """(page_id, idx, gram, inside) of units (page_id, idx, n, letters); one without a trigram has a NULL gram."""
    exploded = units.select("page_id", "idx", "n", characters(F.col("letters")).alias("_chars"))
    grams = exploded.select(
        "page_id",
        "idx",
        "n",
        F.posexplode(trigram_parts(F.col("_chars"))).alias("at", "part"),
    ).filter(F.col("part.c3").isNotNull() | (F.col("at") == 0))
    return grams.select(
        "page_id",
        "idx",
        F.concat("part.c1", "part.c2", "part.c3").alias("gram"),
        (F.col("at") <= F.col("n") - 3).cast("int").alias("inside"),
    )


def page_languages(parsed: DataFrame, model: LanguageModel, bucketed: bool = True) -> DataFrame:
    """Per page_id of :func:`parse_pages` output: ``langs``, its (lang, prob) list, and
    ``par_langs``, the language of each paragraph in array order.

    One pass over the trigrams serves both levels. The text of a page is its paragraphs joined by a
    blank, so its trigrams are those of the paragraphs plus one across each joint; that one is taken
    with the paragraph before the joint and left out of the paragraph's own sum. ``bucketed`` keeps the
    partitions of a table bucketed by page_id; without it, batches of paragraphs are looked up at once.
    """
    indexed = parsed.select(
        "page_id",
        F.transform(
            "paragraphs",
            lambda p, i: F.struct(i.alias("idx"), letters_only(p["content"]).alias("letters")),
        ).alias("_all"),
    )
    split = indexed.select(
        "page_id",
        F.filter("_all", lambda u: F.length(u["letters"]) > 2).alias("_lettered"),
        F.filter("_all", lambda u: F.length(u["letters"]) <= 2).alias("_silent"),
    )
    heads = F.transform("_lettered", lambda u: F.substring(u["letters"], 2, 1))
    joints = F.zip_with(
        "_lettered",
        F.slice(heads, F.lit(2), F.size("_lettered")),
        lambda u, head: F.struct(
            u["idx"].alias("idx"),
            F.concat(u["letters"], F.coalesce(head, F.lit(""))).alias("letters"),
            F.length(u["letters"]).alias("n"),
        ),
    )
    silent = F.transform(
        "_silent",
        lambda u: F.struct(u["idx"].alias("idx"), u["letters"].alias("letters"), F.lit(2).alias("n")),
    )
    units = split.select("page_id", F.inline(F.concat(joints, silent)))
    if model.broadcastable() and not bucketed:
        sums = weigh_texts(units, ["page_id", "idx"], model, F.col("letters"), F.col("n"))
    else:
        sums = weigh(_unit_grams(units), ["page_id", "idx"], model, {"i": F.col("inside"), "s": F.lit(1)}, how="left")
    totals = [F.sum(f"s_{lang}").alias(f"s_{lang}") for lang in model.languages]
    par_langs = F.array_sort(
        F.collect_list(
            F.struct("idx", F.coalesce(top_language(model, "i"), F.lit(NO_FEATURES)).alias("lang"))
        )
    )
    per_page = sums.groupBy("page_id").agg(par_langs.alias("_par"), *totals)
    return per_page.select(
        "page_id",
        language_list(model).alias("langs"),
        F.transform("_par", lambda p: p["lang"]).alias("par_langs"),
    )


def accepted_language(langs: Column, allowed: Sequence[str]) -> Column:
    """The allowed language with a probability above the threshold, else NULL."""
    hits = F.filter(langs, lambda e: e["lang"].isin(*allowed) & (e["prob"] > ACCEPT_ABOVE))
    return F.get(F.transform(hits, lambda e: e["lang"]), F.lit(0))


def page_language_filter(
    rows: DataFrame, allowed: Sequence[str] = DEFAULT_LANGUAGES, keep_errors: bool = True
) -> DataFrame:
    """Keep or drop whole pages by ``langs`` (NULL = undetectable) and set ``page_language``."""
    if DISABLED in allowed:
        return rows.withColumn("page_language", F.lit(None).cast("string"))
    if ANY in allowed:
        label = format_lang_list(F.col("langs"))
        keep = F.col("langs").isNotNull()
    else:
        label = accepted_language(F.col("langs"), allowed)
        keep = label.isNotNull()
    if keep_errors:
        keep = keep | F.col("langs").isNull()
    return rows.filter(keep).withColumn("page_language", label)


def parse_with_languages(
    parsed: DataFrame,
    model: LanguageModel | None,
    allowed: Sequence[str] = DEFAULT_LANGUAGES,
    keep_errors: bool = True,
    bucketed: bool = True,
) -> DataFrame:
    """Paragraph rows with both languages: the whole paragraph parser after extraction.

    ``disabled`` leaves scoring out of the plan. Otherwise pages meet their scores on page_id before
    the paragraphs are exploded; a pages table bucketed by page_id makes that join, and the sums
    below it, free of shuffles.
    """
    kept = [c for c in parsed.columns if c not in ("paragraphs", "page_id")]
    if DISABLED in allowed:
        rows = explode_structs(parsed, ["page_id", *kept], "paragraphs", "pos")
        return page_language_filter(rows, allowed).withColumn(
            "par_language", F.lit(None).cast("string")
        )
    scored = parsed.join(page_languages(parsed, model, bucketed), "page_id")
    selected = page_language_filter(scored, allowed, keep_errors)
    pairs = F.zip_with(
        "paragraphs",
        "par_langs",
        lambda p, lang: F.struct(
            p["xp_idx"].alias("xp_idx"),
            p["pos"].alias("pos"),
            p["origin"].alias("origin"),
            p["content"].alias("content"),
            lang.alias("par_language"),
        ),
    )
    return selected.select("page_id", *kept, "page_language", F.inline(pairs))


def language_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("par_language").agg(F.count(F.lit(1)).alias("n"))


def language_stats(rows: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """Paragraphs per page and language, one column per language."""
    return (
        rows.groupBy("page_id", "url")
        .pivot("par_language", list(languages))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
