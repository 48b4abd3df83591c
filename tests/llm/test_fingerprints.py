"""I-Match fingerprints: order of documents, edits, and separation of near and unrelated texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from trainlake.llm import fingerprints as fp
from trainlake.llm.queries import QUERIES
from trainlake.llm.words import pieces


def follow(docs):
    """doc_id -> (text, next text) in descending order, ties by text."""
    order = sorted(docs, key=lambda d: (-d[0], d[1] or ""))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def check(docs, rows):
    want = sorted((i, len(t), hashlib.sha256(fp.edited(t, n).encode()).hexdigest()) for i, t, n in follow(docs))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    by_text = {}
    texts = {i: t for i, t, _ in follow(docs)}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"]) and 0 <= r["near_next"] <= 1


def test_small_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op8_imatch_fingerprints"](spark, sf).collect()
    check(docs, rows)
    texts = {i: (t, n) for i, t, n in follow(docs)}
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    order = sorted(prints, reverse=True)
    for r, following in zip(sorted(rows, key=lambda r: -r["doc_id"]), [*order[1:], order[0]]):
        assert r["near_next"] == fp.likeness(r["fingerprint"], prints[following])
    near = np.mean([r["near_edited"] for r in rows])
    unrelated = np.mean([r["near_next"] for r in rows if texts[r["doc_id"]][0] != texts[r["doc_id"]][1]])
    assert near > 0.3 and unrelated < 0.05


def test_many_ranges(spark):
    rng = random.Random(1)
    ids = list({rng.randrange(-(2**62), 2**62) for _ in range(300)}) + [-(2**63), 2**63 - 1]
    docs = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))) for i in ids]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        check(docs, fp.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "é" * 50_000 + " a"), (4, "..."), (5, "same text"), (6, "same text"), (None, "x")]
    table = spark.createDataFrame([(i, t, 1, True) for i, t in docs], "doc_id long, text string, range int, tail boolean")
    check(docs[:-1], fp.compare_with_next(table).collect())
    [one] = fp.compare_with_next(table.filter("doc_id = 5")).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"same tsam").hexdigest()
    assert fp.compare_with_next(table.limit(0)).count() == 0


def test_repeated_ids(spark):
    docs = [(1, "b"), (1, "a"), (2, "c d"), (1, "b")]
    rows = fp.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 1, 2]


def test_band_counts_documents(spark):
    texts = ["common rare%d pair%d" % (k, k // 2) for k in range(100)]
    within = fp.band(spark.createDataFrame([(t,) for t in texts], "text string"))

    def known(term):
        [(_, _, words)] = list(pieces(pa.array([term])))
        return bool(within[fp._bucket(fp._terms(words)[0])][0])

    assert not known("common") and not known("rare3") and known("Pair7,")
