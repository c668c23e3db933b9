from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagemill.operators import language as L
from pagemill.operators.paragraphs import page_text, parse_pages
from pagemill.plans import fixtures as fx

LANGS = ("de", "en")


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.train(fx.documents(spark, sf_dir), fx.MODEL_LANGUAGES)


@pytest.fixture(scope="module")
def parsed(spark, sf_dir):
    return parse_pages(fx.td_pages(spark, sf_dir))


def rows(df):
    return sorted(df.collect(), key=repr)


def test_shuffled_profile_gives_the_same_scores(spark, sf_dir, model, parsed):
    far = replace(model, broadcast_limit=0)
    assert model.broadcastable() and not far.broadcastable()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    keys = ["conv_id", "turn"]
    assert rows(L.score_texts(turns, keys, "text", model)) == rows(L.score_texts(turns, keys, "text", far))
    assert rows(L.page_languages(parsed, model)) == rows(L.page_languages(parsed, far))
    assert "Broadcast" not in L.score_texts(turns, keys, "text", far)._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_texts_give_the_same_scores_without_a_row_for_each_trigram(spark, model):
    """Texts of all kinds, empty and null ones, letters beyond 16 bits, repeated and null keys, against exploded trigrams."""
    texts = ["the house", None, "", "12 !", "a", "\U00010400\U00010401\U00010402 is", "été à la plage", "Ünder Straße " * 9, "zzqx"]
    pairs = [(k, t) for k, t in enumerate(texts)] + [(0, "is mine"), (None, "das ist"), (None, "x")]
    docs = spark.createDataFrame(pairs, "k long, t string")
    want = L.weigh(L.explode_grams(docs, ["k"], "t"), ["k"], model, {"s": F.lit(1)})
    got = L.score_texts(docs, ["k"], "t", model)
    assert rows(got) == rows(want) and "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    named = docs.withColumn("lang", F.when(F.col("k") != 7, F.lit("en")))
    want = L.explode_grams(named, ["lang"], "t").groupBy("lang", "gram").count()
    got = L.gram_counts(named, "t")
    assert rows(got.select("lang", "gram", F.col("cnt").alias("count"))) == rows(want)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pages_in_batches_have_the_same_languages(spark, model, parsed):
    html = ["<p>12</p><p>the house</p><p>...</p><p>is mine</p>", "<p>1 2</p>", None, "<p>a</p><p>b</p>", "<p>und das</p><p>zzqx</p>"]
    odd = spark.createDataFrame([(k % 4, "u", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    for pages in (parsed, parse_pages(odd, ["//p"])):
        got = L.page_languages(pages, model, bucketed=False)
        assert rows(got.select("page_id", "langs", "par_langs")) == rows(L.page_languages(pages, model))


def test_one_pass_equals_scoring_texts_apart(model, parsed):
    whole = L.score_texts(page_text(parsed), ["page_id"], "page_text", model).select(
        "page_id", L.language_list(model).alias("langs")
    )
    once = L.page_languages(parsed, model)
    assert rows(once.filter("langs is not null").select("page_id", "langs")) == rows(whole)


def test_letterless_paragraphs_do_not_break_joints(spark, model):
    html = "<p>12</p><p>the house</p><p>...</p><p>is mine</p><p>34</p>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", "<p>1 2</p>")], "page_id long, url string, html string")
    parsed = parse_pages(df, ["//p"])
    got = {r.page_id: r for r in L.page_languages(parsed, model).collect()}
    assert [x == L.NO_FEATURES for x in got[1].par_langs] == [True, False, True, False, True]
    assert got[2].langs is None and got[2].par_langs == [L.NO_FEATURES]
    whole = L.score_texts(page_text(parsed), ["page_id"], "page_text", model)
    assert got[1].langs == whole.filter("page_id = 1").select(L.language_list(model)).first()[0]


def test_top_grams_equals_plain_ranking(spark, sf_dir):
    counts = L.gram_counts(fx.documents(spark, sf_dir))
    want = sorted(
        (r for r in counts.collect()), key=lambda r: (r.lang, -r.cnt, r.gram.encode())
    )
    kept, seen = [], {}
    for r in want:
        seen[r.lang] = seen.get(r.lang, 0) + 1
        if seen[r.lang] <= 50:
            kept.append((r.lang, r.gram, r.cnt))
    got = [(r.lang, r.gram, r.cnt) for r in L.top_grams(counts, 50, salts=7).collect()]
    assert sorted(got) == sorted(kept)


def test_accuracy_on_documents_left_out(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    model = L.train(docs.filter("doc_id % 5 <> 0"), fx.MODEL_LANGUAGES)
    held = docs.filter("doc_id % 5 = 0")
    top = L.score_texts(held, ["doc_id"], "text", model).select("doc_id", L.top_language(model).alias("l"))
    hits = held.join(top, "doc_id").agg(F.avg((F.col("l") == F.col("lang")).cast("double"))).first()[0]
    assert hits > 0.95


def test_saved_model_scores_the_same(spark, model, tmp_path):
    L.save_model(model, str(tmp_path / "model"))
    again = L.load_model(spark, str(tmp_path / "model"))
    assert again.languages == model.languages
    assert rows(again.profile) == rows(model.profile)


def page(spark, langs):
    kind = "array<struct<lang:string,prob:double>>"
    return spark.createDataFrame([(1, langs)], f"page_id long, langs {kind}")


def kept(df):
    return [r.page_language for r in df.collect()]


def test_page_rules(spark):
    half = page(spark, [("en", 0.5), ("fr", 0.4)])
    more = page(spark, [("en", 0.5001)])
    none = page(spark, None)
    assert kept(L.page_language_filter(half, LANGS)) == []
    assert kept(L.page_language_filter(more, LANGS)) == ["en"]
    assert kept(L.page_language_filter(more, ("fr",))) == []
    assert kept(L.page_language_filter(half, ("any",), False)) == ["[en:0.5, fr:0.4]"]
    for allowed in (LANGS, ("any",)):
        assert kept(L.page_language_filter(none, allowed, True)) == [None]
        assert kept(L.page_language_filter(none, allowed, False)) == []
    for df in (half, none):
        assert kept(L.page_language_filter(df, ("disabled", "en"), False)) == [None]


def test_ties_go_to_the_later_code(spark):
    model = L.LanguageModel(spark.range(0), ("de", "en"), 0)
    df = spark.createDataFrame([(5, 5), (6, 5)], "s_de long, s_en long")
    assert [r[0] for r in df.select(L.top_language(model)).collect()] == ["en", "de"]


def test_disabled_leaves_scoring_out(spark, sf_dir, parsed):
    df = L.parse_with_languages(parsed, None, ("disabled",))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.filter("par_language is not null or page_language is not null").count() == 0
