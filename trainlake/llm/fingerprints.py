"""I-Match fingerprints with several randomised lexicons.

Terms whose inverse document frequency lies in a band (neither rare nor
common in all documents) form the lexicon; a randomised lexicon keeps a hashed
share of it.  The distinct terms of a document that a lexicon keeps, sorted,
are hashed to one component.  Shares come in powers of 1/4: a document uses the
lexicons that keep about one to four of its terms and those one level sparser,
so an edit changes some components and leaves others, for short and long texts
alike.  The likeness of two fingerprints is the share of equal components.

Document frequencies are counted over all documents into a sketch of fixed
size; terms that fall into one bucket share its count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bare, distinct, mix, pieces, spelled

LEXICONS = 16
# The band: in at least this many documents, and at most this share of them.
LEAST_DOCUMENTS = 2
MOST_SHARE = 0.05
BUCKETS = 1 << 21
CHUNKS = 64
# Rows that are fingerprinted at a time.
ROWS = 400

_SEEDS = np.random.default_rng(31).integers(1, 2**63, LEXICONS).astype(np.uint64)


def _terms(words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each document as hashes, and offsets."""
    return distinct(mix(spelled(*bare(words))), words.first.copy()) if len(words) else (np.zeros(0, np.uint64), words.first)


def _bucket(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)


def band(docs: DataFrame) -> np.ndarray:
    """Per bucket whether its terms are in the band; counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, words in pieces(batch["text"]):
                total += np.bincount(_bucket(_terms(words)[0]), minlength=BUCKETS)
        if n:
            parts = [p.tobytes() for p in total.reshape(CHUNKS, -1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] + [0] * (CHUNKS - 1), pa.int64())], names=["chunk", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, counts, n in zip(batch["chunk"].to_pylist(), batch["counts"], batch["n"].to_pylist()):
                have = sums.setdefault(chunk, [np.zeros(BUCKETS // CHUNKS, np.int64), 0])
                have[0] += np.frombuffer(counts.as_buffer(), np.int32)
                have[1] += n
        order = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int32()), pa.array([sums[k][0].tobytes() for k in order], pa.binary()), pa.array([sums[k][1] for k in order], pa.int64())], names=["chunk", "counts", "n"]
        )

    schema = "chunk int, counts binary, n long"
    # A chunk is summed as its rows pass by; the driver gets CHUNKS rows.
    rows = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    counts = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    n = sum(r["n"] for r in rows)
    counts = counts.ravel()
    return (counts >= LEAST_DOCUMENTS) & (counts <= max(MOST_SHARE * n, LEAST_DOCUMENTS))


def fingerprints(texts: list[str], within: np.ndarray) -> list[str]:
    """The components of each text, joined by spaces.

    A component names its level, lexicon and hash; lexicons that keep nothing
    have none.  A text without terms in the band has the hash of all its terms.
    """
    out = []
    for i, j, words in pieces(pa.array(texts, pa.large_string())):
        terms, offsets = _terms(words)
        doc = np.repeat(np.arange(j - i), np.diff(offsets))
        good = within[_bucket(terms)]
        whole = np.concatenate([[np.uint64(0)], np.cumsum(mix(terms))])
        whole = whole[offsets[1:]] - whole[offsets[:-1]]
        kept, doc = terms[good], doc[good]
        n = np.bincount(doc, minlength=j - i)
        start = np.concatenate([[0], np.cumsum(n)])
        # 4**level <= n < 4**(level + 1)
        level = np.array([max(0, (int(k).bit_length() - 1) // 2) for k in n])
        parts: list[list[str]] = [[] for _ in range(j - i)]
        for s, seed in enumerate(_SEEDS):
            drawn = mix(kept ^ seed)
            code = mix(drawn)
            for step in (0, 1):
                shift = 2 * (level + step)
                chosen = (drawn >> (np.uint64(64) - np.maximum(shift, 1).astype(np.uint64))[doc] == 0) | (shift[doc] == 0)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(chosen, code, np.uint64(0)))])
                held = np.bincount(doc[chosen], minlength=j - i)
                value = mix(sums[start[1:]] - sums[start[:-1]]) >> np.uint64(32)
                for d, l, v in zip(np.flatnonzero(held).tolist(), (level + step)[held > 0].tolist(), value[held > 0].tolist()):
                    parts[d].append(f"{l:x}.{s:x}:{v:08x}")
        out += [" ".join(p) if p else f"all:{w:016x}" for p, w in zip(parts, whole.tolist())]
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal components, of those of the fingerprint with more."""
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    return len(x & y) / max(len(x), len(y))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text's beginning."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _with_next(within):
    """Rows in order, each run closed by a tail row: fingerprints of all but the tails."""

    def run(batches):
        left = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part["text"].to_pylist()]
                rows = list(zip(part["doc_id"].to_pylist(), part["tail"].to_pylist(), texts, fingerprints(texts, within.value)))
                if left is not None:
                    rows.insert(0, left)
                left = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
                changed = [edited(a[2], b[2]) for a, b in pairs]
                prints = fingerprints(changed, within.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                        pa.array([a[3] for a, _ in pairs], pa.string()),
                        pa.array(prints, pa.string()),
                        pa.array([likeness(a[3], p) for (a, _), p in zip(pairs, prints)], pa.float64()),
                        pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited form and the next document's.

    The next document has the next smaller doc_id, after the last one the
    largest.  Rows are dealt by ranges of doc_id; the first row of each range
    also closes the range before it, so texts move once.

    Defined cases: a null text counts as empty; equal texts have equal
    fingerprints; rows with equal doc_id follow each other in the order of
    their texts; a single row is its own next; rows without doc_id are left
    out; an empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    within = spark.sparkContext.broadcast(band(docs))

    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = F.percentile_approx("doc_id", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(20 * ranges))
    bounds = sorted(set(docs.select(marks.alias("m")).first()["m"] or []))
    higher = F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b > F.col("doc_id"))
    dealt = docs.withColumn("range", F.size(higher))
    # One row per range: its first document, and the range that it closes.
    firsts = dealt.groupBy("range").agg(F.max("doc_id").alias("first")).orderBy("range").collect()
    closes = [(r["first"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    closing = spark.createDataFrame(closes, "doc_id long, closed int")
    dealt = dealt.join(F.broadcast(closing), "doc_id", "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("closed").alias("range"), F.lit(True).alias("tail"))
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.col("closed").isNull(), F.array(own)).otherwise(F.array(own, tail))).alias("to"))
    dealt = dealt.select("to.range", "to.tail", "doc_id", "text")
    run, schema = _with_next(within)
    return dealt.repartition("range").sortWithinPartitions("range", "tail", F.desc("doc_id"), "text").select("doc_id", "tail", "text").mapInArrow(run, schema)
