"""Input columns that carry the names used inside: kept as they are, none lost."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trainlake.llm import embeddings, fingerprints, html, mixing, near, packing, sharding, substring, tokens, toxicity, urls

INSIDE = ("_source", "_cdf", "_salt", "_at", "_spans", "_cut", "_scored", "_url", "cdf", "rank", "cell", "shard", "key", "n", "k", "row", "part", "run", "chunk", "level", "group")


@pytest.fixture(scope="module")
def docs(spark):
    text = F.concat(F.lit("some words of document "), (F.col("id") % 7).cast("string"), F.lit(" that go on for a while and then end here"))
    rows = spark.range(40).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    return rows.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in INSIDE])


def carried(df, name="doc_id"):
    """Every column of the input arrives with its own value."""
    for r in df.collect():
        assert all(r[c] == f"{c} {r[name]}" for c in INSIDE), r
    return df


def test_mixing(spark, docs, monkeypatch):
    for entries in (mixing.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", entries)
        out = carried(mixing.mix_sources(docs, mixing.temperature_weights(docs)))
        assert out.columns == [*docs.columns, "copies", "copy"]


def test_substring(docs):
    assert carried(substring.remove_repeats(docs, 5)).columns == [*docs.columns, "n_words", "n_removed", "kept_text"]


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert carried(toxicity.score_toxicity(docs, labels)).columns == [*docs.columns, "score", "predicted", "toxic_spans"]


def test_urls_and_pages(spark, docs):
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit("http://a.org/x")).withColumn("html", F.lit("<p>x"))
    rules = urls.rules_table(spark, [("block", "org", "/")])
    assert carried(urls.judge_urls(pages, rules), "page_id").columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert carried(html.extract_text(pages), "page_id").columns == [*[c for c in pages.columns if c != "text"], "text", "n_chars"]


def test_operators_with_columns_of_their_own(spark, docs):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    assert near.near_duplicates(docs, 2).count() == 40
    assert sharding.shard_rows(docs, 3).count() == 40
    assert packing.pack(docs, word, 64).count() >= 40
    assert fingerprints.compare_with_next(docs).count() == 40
    assert tokens.count_tokens(docs, byte).count() == 40
    vectors = docs.withColumnRenamed("doc_id", "vec_id").withColumn("embedding", F.array(*[F.lit(float(k)) for k in range(8)]))
    assert embeddings.near_vectors(vectors, 0.95).count() == 40
