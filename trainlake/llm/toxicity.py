"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are per document, so token labels are derived first: over the sampled
training documents each word and word beginning gets its log-odds between
toxic and clean documents, and words of toxic documents with strong odds are
toxic tokens.  The chain has two states; its weights (hashed features of the
word, its beginnings, its end and its neighbours, plus transitions) maximise
the likelihood of these token labels.  Forward-backward marginals of every
token of the whole text are then aggregated: their largest logit and expected
count enter a calibrated document score, runs of likely toxic tokens are the
offending spans.

The fit sees at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled documents, a
fixed choice by hash; scoring reads every text of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import unused
from .words import Words, bare, mix, pieces, spelled

# Bounds of the training sample, in documents.
SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 1500
BUCKETS = 1 << 18
EPOCHS = 20
# A token of a toxic document is toxic from these log-odds on.
TOKEN_ODDS = 3.0
SPAN_PROBABILITY = 0.5
THRESHOLD = 0.3

_STARTS = (3, 4, 5, 6, 7)
# Features 0 to EVIDENCE - 1 describe the word itself.
EVIDENCE = 1 + len(_STARTS)


def features(words: Words) -> np.ndarray:
    """Feature buckets, a row per feature and a column per word.

    A word is taken without the punctuation around it.
    """
    n = len(words)
    if n == 0:
        return np.zeros((EVIDENCE + 3, 0), np.int64)
    codes, start, end = bare(words)
    whole = spelled(codes, start, end)
    edge = np.zeros(n, bool)
    edge[words.first[:-1][words.first[:-1] < n]] = True
    before, after = np.roll(whole, 1), np.roll(whole, -1)
    before[edge] = 0
    after[np.append(np.flatnonzero(edge)[1:] - 1, n - 1)] = 0
    rows = [whole]
    rows += [np.where(end - start >= k, spelled(codes, start, np.minimum(start + k, end)), np.uint64(0)) for k in _STARTS]
    rows += [spelled(codes, np.maximum(end - 4, start), end), before, after]
    return np.stack([mix(r ^ np.uint64(1000003 * k)) & np.uint64(BUCKETS - 1) for k, r in enumerate(rows)]).astype(np.int64)


def _times(a, b):
    """Products of 2x2 matrices, given as (4, n); scaled to a largest entry of one."""
    out = np.empty_like(b if b.shape[1] > a.shape[1] else a)
    out[0] = a[0] * b[0] + a[1] * b[2]
    out[1] = a[0] * b[1] + a[1] * b[3]
    out[2] = a[2] * b[0] + a[3] * b[2]
    out[3] = a[2] * b[1] + a[3] * b[3]
    return out / out.max(axis=0)


def _prefixes(m: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Products of the first 1, 2, .. n matrices, by chunks side by side."""
    n = m.shape[1]
    if n <= chunk:
        out = m.copy()
        for t in range(1, n):
            out[:, t : t + 1] = _times(out[:, t - 1 : t], m[:, t : t + 1])
        return out
    columns = -(-n // chunk)
    padded = np.zeros((4, columns * chunk))
    padded[[0, 3]] = 1
    padded[:, :n] = m
    laid = np.ascontiguousarray(padded.reshape(4, columns, chunk).transpose(0, 2, 1))
    for t in range(1, chunk):
        laid[:, t] = _times(laid[:, t - 1], laid[:, t])
    totals = _prefixes(laid[:, -1], chunk)
    ahead = np.roll(totals, 1, axis=1)
    ahead[:, 0] = [1, 0, 0, 1]
    flat = laid.transpose(0, 2, 1).reshape(4, -1)[:, :n]
    return _times(np.repeat(ahead, chunk, axis=1)[:, :n], flat)


@dataclass
class Chain:
    """Weights of the two-state chain; state 1 is toxic."""

    weights: np.ndarray
    start: float
    moves: np.ndarray  # log potentials, flattened 2x2
    calibration: np.ndarray

    def _matrices(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = np.exp(np.clip(emission, -30, 30))
        t = np.exp(self.moves)
        m = np.stack([np.full_like(e, t[0]), t[1] * e, np.full_like(e, t[2]), t[3] * e])
        m[0, first] = m[2, first] = 1
        m[1, first] = m[3, first] = np.exp(self.start) * e[first]
        return m

    def emission(self, feats: np.ndarray) -> np.ndarray:
        total = np.zeros(feats.shape[1])
        for f in feats:
            total += self.weights[f]
        return total

    def forward_backward(self, emission: np.ndarray, first: np.ndarray):
        """Scaled forward and backward vectors, (2, n), and the matrices; documents start at ``first``."""
        m = self._matrices(emission, first)
        ahead = _prefixes(m)[:2]
        turned = m[:, ::-1][[0, 2, 1, 3]]
        # The product of all later matrices, applied to ones.
        later = _prefixes(turned)
        behind = np.stack([later[0] + later[2], later[1] + later[3]])[:, ::-1]
        back = np.ones_like(ahead)
        back[:, :-1] = behind[:, 1:]
        return ahead / ahead.sum(axis=0), back / back.sum(axis=0), m

    def marginals(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of the toxic state per token."""
        if feats.shape[1] == 0:
            return np.zeros(0)
        a, b, _ = self.forward_backward(self.emission(feats), first)
        joint = a * b
        return joint[1] / joint.sum(axis=0)


def _summary(marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: largest logit, log expected count of toxic tokens, one."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    out[:, 0], out[:, 1], out[:, 2] = -12, np.log(1e-3), 1
    full = np.flatnonzero(n > 0)
    if len(full):
        p = np.clip(marginals, 6e-6, 1 - 6e-6)
        out[full, 0] = np.log(np.maximum.reduceat(p, first[:-1][full]) / (1 - np.maximum.reduceat(p, first[:-1][full])))
        out[full, 1] = np.log(np.add.reduceat(marginals**2, first[:-1][full]) + 1e-3)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _token_odds(parts: list[np.ndarray], docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Per feature of a word itself and bucket: log-odds of toxic documents less one deviation."""
    n_toxic, n_clean = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    out = np.empty((EVIDENCE, BUCKETS), np.float32)
    for k in range(EVIDENCE):
        seen = np.zeros((2, BUCKETS))
        for feats, doc in zip(parts, docs):
            pairs = np.unique(doc * BUCKETS + feats[k])
            for c in (0, 1):
                seen[c] += np.bincount(pairs[toxic[pairs // BUCKETS] == bool(c)] % BUCKETS, minlength=BUCKETS)
        c, t = seen
        out[k] = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        out[k][t < max(3, 0.01 * n_toxic)] = -np.inf
    return out


def fit_chain(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> Chain:
    """Fit on texts with document labels; ``weight`` restores the classes' shares for the calibration.

    Works through the texts in pieces, so only the features of all tokens are held.
    """
    parts, firsts, docs = [], [], []
    for i, _, words in pieces(pa.array(texts, pa.string())):
        parts.append(features(words).astype(np.int32))
        firsts.append(words.first)
        docs.append(words.doc_of() + i)
    chain = Chain(np.zeros(BUCKETS), -4.0, np.array([0.0, -4.0, -1.0, -1.0]), np.zeros(3))
    if not toxic.any():
        chain.calibration = np.array([0.0, 0.0, -np.inf])
        return chain
    odds = _token_odds(parts, docs, toxic)
    # Words of toxic documents whose form or beginning is strongly tied to toxicity.
    labels = [(np.max([odds[k][f] for k, f in enumerate(feats[:EVIDENCE])], axis=0) >= TOKEN_ODDS) & toxic[doc] for feats, doc in zip(parts, docs)]
    starts = [first[:-1][np.diff(first) > 0] for first in firsts]
    size, moved = np.full(BUCKETS, 1e-8), np.full(4, 1e-8)
    for _ in range(EPOCHS):
        grad, step = -1e-2 * chain.weights, -1e-2 * chain.moves
        for feats, y, start in zip(parts, labels, starts):
            if not len(y):
                continue
            a, b, m = chain.forward_backward(chain.emission(feats), start)
            joint = a * b
            slope = y - joint[1] / joint.sum(axis=0)
            for f in feats:
                grad += np.bincount(f, slope, minlength=BUCKETS)
            inner = np.ones(len(y), bool)
            inner[start] = False
            state, left = y.astype(np.int64), np.roll(a, 1, axis=1)
            pair = np.stack([left[0] * m[0] * b[0], left[0] * m[1] * b[1], left[1] * m[2] * b[0], left[1] * m[3] * b[1]])
            step += np.bincount((2 * np.roll(state, 1) + state)[inner], minlength=4) - (pair / pair.sum(axis=0))[:, inner].sum(axis=1)
        size += grad**2
        moved += step**2
        chain.weights += 0.5 * grad / np.sqrt(size)
        chain.moves = chain.moves + 0.5 * step / np.sqrt(moved)
    chain.weights = chain.weights.astype(np.float32)
    told = [_summary(chain.marginals(feats, start), first) for feats, start, first in zip(parts, starts, firsts)]
    chain.calibration = _logistic(np.concatenate(told), toxic.astype(float), weight)
    return chain


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain on a bounded, hash-chosen sample of the labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()
    toxic = np.array([r["toxic"] == 1 for r in rows], bool)
    share = np.array([totals.get(k, 0) / max((toxic == bool(k)).sum(), 1) for k in (0, 1)])
    weight = share[toxic.astype(int)] * len(rows) / max(sum(totals.values()), 1) if len(rows) else np.zeros(0)
    return fit_chain([r["text"] for r in rows], toxic, weight)


def _scorer(chain):
    @F.arrow_udf(
        T.StructType(
            [
                T.StructField("score", T.DoubleType()),
                T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            ]
        )
    )
    def score(text: pa.Array) -> pa.Array:
        model = chain.value
        scores, spans = [], []
        for i, j, words in pieces(text):
            n = np.diff(words.first)
            p = model.marginals(features(words), words.first[:-1][n > 0])
            x = _summary(p, words.first)
            scores.append(1 / (1 + np.exp(-np.clip(x @ model.calibration, -np.inf, 40))))
            found = [[] for _ in range(j - i)]
            bad = np.flatnonzero(p >= SPAN_PROBABILITY)
            if len(bad):
                doc = words.doc_of()[bad]
                points = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
                for d, s, e, k in zip(doc.tolist(), points[words.start[bad]].tolist(), points[words.end[bad]].tolist(), bad.tolist()):
                    zero = int(points[words.origin[d]])
                    last = found[d][-1] if found[d] else None
                    if last and last["k"] == k - 1:
                        last.update(end=e - zero, k=k)
                    else:
                        found[d].append({"start": s - zero, "end": e - zero, "k": k})
            spans += [[{"start": f["start"], "end": f["end"]} for f in fs] for fs in found]
        # What the pieces took is given back; the worker lives on for other stages.
        pa.default_memory_pool().release_unused()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, kind)], names=["score", "spans"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1), predicted (score >= threshold) and toxic_spans to every row of ``docs``.

    Spans are [start, end) in code points of the whole text.  Only ``text``
    enters a score; ``docs`` columns of the new names are replaced.

    Defined cases: null and empty texts score as texts without words; equal
    texts score alike; labels that are null or not 0 or 1 are ignored, and so
    are held-out rows.  Without any document labelled toxic every
    score is 0.
    """
    chain = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    keep = docs.drop("score", "predicted", "toxic_spans")
    result = unused("_scored", keep)
    scored = keep.withColumn(result, _scorer(chain)("text"))
    return scored.select(
        *[F.col(f"`{c}`") for c in keep.columns],
        F.col(f"{result}.score").alias("score"),
        (F.col(f"{result}.score") >= threshold).cast("int").alias("predicted"),
        F.col(f"{result}.spans").alias("toxic_spans"),
    )
