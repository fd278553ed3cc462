"""Nulls, empty tables, repeats, ties, very long texts and extra columns: every operator has a defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, class_lm, decontamination, html_text, language_id, mixing, quality_lm, quality_rules, secrets, simhash

LONG = "the quick token = abcdef123456 jumps over 0123456789abcdef0123456789abcdef and so on\n" * 6000
ROWS = [
    (1, "the cat sat on the mat and it was good", "en", "a", 38), (1, "the cat sat on the mat and it was good", "en", "a", 38),
    (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \t\n", "fr", "b", 5), (None, "le chat et la souris", "fr", None, 20),
    (5, LONG, "en", "a", len(LONG)), (6, "le chat est sur la table et il est bon", "fr", "b", 38), (7, "été Ünïcode ſecret: 漢字 🎉", None, "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "n_words __shard shard row key n word k size block fp score kept __ppl perplexity kept_id mixed_id mix_shards a b a.b `q` A.B.c Text_ ppl c0 c1 shard_".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, labels, items, tmp_path_factory):
    """The tables that the pipeline's stages read beside the documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{at}/labels.parquet")
    items.write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, None), (2, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, "..."), (4, "the cat sat on the mat"), (None, "souris")], "item_id long, text string")


def count(df):
    return len(df.collect())


def test_decontamination(docs, none, items):
    found = {(r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(docs, items).collect()}
    assert found == {(1, 1, 0), (1, 4, 0), (None, None, 0)}
    assert count(decontamination.leaks(none, items)) == 0
    assert count(decontamination.leaks(docs, items.limit(0))) == 0
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {2, 3, 4, 5, 6, 7}


def test_quality_classifier(docs, none, labels):
    rows = quality_lm.classify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert not any(r.kept for r in rows if r.perplexity is None) and sum(r.perplexity is None for r in rows) == 2
    assert count(quality_lm.classify(none, labels)) == 0
    assert all(r.kept for r in quality_lm.classify(docs, labels.limit(0)).collect() if r.perplexity is not None)
    kept = quality_lm.keep_good(docs, labels)
    assert kept.columns == docs.columns and {1, 6} <= {r.doc_id for r in kept.collect()}


def test_language(docs, none):
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert count(language_id.identify(none)) == 0


def test_mixing(docs, none):
    rows = mixing.decide(docs).collect()
    assert len(rows) == len(ROWS) and all(len(r.shards) <= 2 for r in rows)
    assert all(not r.shards for r in rows if r["size"] == 0)
    assert count(mixing.decide(none)) == 0 and count(mixing.mix(none)) == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy", "mix_shard"]


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "\\"), (2, 1, "assistant", ""), (3, 0, "a:b", "###### </turn></turn>"), (3, 0, "a:b", "###### </turn></turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(out) == {None, 1, 2, 3} and out[1].n_turns == 3 and out[1].loss_chars == 5 and out[3].n_turns == 2
    assert count(chat.read_back(chat.format_conversations(df.limit(0)))) == 0


def test_secrets(docs, none):
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_hex for r in rows if r.doc_id == 5} == {6000} and {r.n_assign for r in rows if r.doc_id in (5, 7)} == {6000, 0}
    assert count(secrets.scan(none)) == 0
    assert secrets.redact(docs).columns == docs.columns and count(secrets.redact(docs)) == len(ROWS)


def test_both_ways_of_scoring_are_equal_to_the_bit(spark, sf, docs, labels):
    rows = lambda df: sorted((str(r.doc_id), r.lang, r.perplexity, r.threshold, r.kept) for r in df.collect())
    assert rows(quality_lm.classify(docs, labels)) == rows(quality_lm.classify(docs, labels, 0))
    whole, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert rows(quality_lm.classify(whole, marks)) == rows(quality_lm.classify(whole, marks, 0))
    assert quality_lm.keep_good(docs, labels, 0).columns == docs.columns


def test_whole_pipeline(spark, docs, folder):
    """Null ids, null, empty and repeated texts, null sources and odd names go through all stages; an empty table gives an empty mix."""
    for given in (docs, docs.limit(0)):
        rows, at = given, f"{folder}/out-{given.count()}"
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, folder)
            assert out.columns[: len(docs.columns)] == docs.columns
            out.write.parquet(f"{at}/{i}")
            rows = spark.read.parquet(f"{at}/{i}")
        assert rows.count() <= 2 * given.count() and rows.where("text IS NULL").count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (2, 3, 4)} == {("0" * 16, 2)}
    assert count(simhash.near_duplicates(none)) == 0

def test_class_lm(docs, none):
    rows = class_lm.class_scores(docs, classes=4, rounds=1).collect()
    assert len(rows) == len(ROWS) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert count(class_lm.class_scores(none, classes=4, rounds=1)) == 0


def test_rules(docs, none):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed and not r.kept for r in rows if r.doc_id != 5)
    assert [r.n_repeat_words == r.n_words for r in rows if r.doc_id == 5] == [True]
    assert count(quality_rules.quality_rules(none)) == 0


def test_html(spark):
    deep = "<div>" * 3000 + "<p>deep text</p>"
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<<p>a < b &amp; c"), (3, "u", "<<p>a < b &amp; c"), (4, "u", deep), (5, "u", "<p>x" * 20000), (6, "u", "</div></p><p class='"), (7, "u", "<script>never closed <p>no</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    rows = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert rows[1] == rows[2] == rows[7] == "" and rows[4] == "deep text" and rows[5] == "\n".join(["x"] * 20000)
    assert "a < b & c" in rows[3]
    assert count(html_text.extract(df.limit(0))) == 0
