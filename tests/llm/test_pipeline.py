"""Each stage of the pipeline against a plain version on its own input."""

import zlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline

from .test_near import brute as brute_near
from .test_substring import brute as brute_cut


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "minhash_near_dedup", "substring_dedup", "poisson_mixing", "best_fit_packing"]

    clean = steps["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0").collect()}
    gone = {i for i, _ in texts(docs)} - {i for i, _ in texts(clean)}
    assert len(gone & toxic) <= 0.1 * len(toxic)

    near = steps["minhash_near_dedup"](spark, clean, sf).cache()
    want = {i for i, c in brute_near(texts(clean), 5).items() if i == c}
    assert near.columns == docs.columns and sorted(i for i, _ in texts(near)) == sorted(want)

    cut = steps["substring_dedup"](spark, near, sf).cache()
    before = dict(texts(near))
    expected = {i: (before[i] if not k else t) for i, (n, k, t) in brute_cut(texts(near), 20).items() if not k or k < n}
    assert cut.columns == docs.columns and dict(texts(cut)) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = steps["poisson_mixing"](spark, cut, sf).cache()
    assert mixed.columns == docs.columns and set(texts(mixed)) <= set(texts(cut)) and mixed.count() > 0.7 * cut.count()

    packed = steps["best_fit_packing"](spark, mixed, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(mixed))
    assert sum(r["length"] for r in packed) == sum(lengths)


def test_odd_rows(spark, sf):
    rows = [(None, "no id", None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "twice the same row", "en", "s", 18), (3, "twice the same row", "en", "s", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        out = given
        for _, stage in pipeline.STAGES:
            out = stage(spark, out, sf)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        out.collect()
    near = dict(pipeline.STAGES)["minhash_near_dedup"](spark, docs, sf)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "None"]


def test_run(spark, sf):
    got = entry.queries()["pipeline"](spark, sf)
    assert got.count() > 0 and zlib.crc32(b"") == 0
