"""The chain against enumeration of all paths, and the scores on held-out labels."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from trainlake.llm import toxicity
from trainlake.llm.queries import QUERIES
from trainlake.llm.words import pieces


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    weights = rng.standard_normal(toxicity.BUCKETS)
    chain = toxicity.Chain(weights, -0.7, rng.standard_normal(4), np.zeros(3))
    texts = ["a b c d", "", "x", "y z w"]
    [(_, _, words)] = list(pieces(pa.array(texts)))
    feats = toxicity.features(words)
    got = chain.marginals(feats, words.first[:-1][np.diff(words.first) > 0])
    e, at = chain.emission(feats), 0
    for text in texts:
        n = len(text.split())
        total, toxic = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            score = sum(e[at + k] * s for k, s in enumerate(path)) + (chain.start * path[0] if n else 0)
            score += sum(chain.moves[2 * a + b] for a, b in zip(path, path[1:]))
            total += np.exp(score)
            toxic += np.exp(score) * np.array(path)
        assert np.allclose(got[at : at + n], toxic / total)
        at += n


def test_prefixes_by_chunks():
    rng = np.random.default_rng(2)
    m = rng.random((4, 1000)) + 0.1
    got, running = toxicity._prefixes(m, 7), np.eye(2)
    for k in range(1000):
        running = running @ m[:, k].reshape(2, 2)
        running /= running.max()
        assert np.allclose(got[:, k].reshape(2, 2) / got[:, k].max(), running)


def corpus(spark, n=600):
    rng = np.random.default_rng(3)
    words = ["w%d" % k for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 30))
        if i % 5 == 0:
            text[int(rng.integers(30))] = rng.choice(["Grumpf!", "grumpfen", "snarkel,"])
        rows.append((i, " ".join(text), 0.5, "x"))
        labels.append((i, int(i % 5 == 0)))
    schema = "doc_id long, text string, score double, spans string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_words_and_spans(spark):
    docs, labels = corpus(spark)
    out = toxicity.score_toxicity(docs, labels)
    assert out.columns == ["doc_id", "text", "spans", "score", "predicted", "toxic_spans"]
    rows = [r for r in out.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in rows)
    spans = [r["text"][s["start"] : s["end"]] for r in rows for s in r["toxic_spans"]]
    assert len(spans) >= 20 and all("rumpf" in s or "snarkel" in s for s in spans)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    odd = [(None, None), (1, ""), (2, " \n"), (3, "ÄÉ grumpf " * 40_000), (3, "..."), (4, "w1")]
    table = spark.createDataFrame([(i, t, 1.0, "s") for i, t in odd], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7), (5, 1)], labels.schema))
    out = toxicity.score_toxicity(docs.unionByName(table), more).collect()
    assert len(out) == 206 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not (r["text"] or "").strip()}) == 1
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {(r["score"], r["predicted"]) for r in toxicity.score_toxicity(table, none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(table.limit(0), labels).count() == 0


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op7_toxicity"](spark, sf).collect()
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    caught = sum(y and p for y, p in held) / sum(y for y, _ in held)
    false = sum(p and not y for y, p in held) / sum(not y for y, _ in held)
    assert caught > 0.75 and false < 0.05
