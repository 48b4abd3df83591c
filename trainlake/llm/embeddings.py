"""Embedding near-dedup by spherical-cap filters.

Filter directions have a product structure: the (randomly rotated) space is
cut into ``BLOCKS`` parts, each with a code of random unit vectors; a direction
is one codeword per part.  A vector belongs to every filter whose direction it
exceeds a cap with; list decoding finds those by adding the parts' scores
without walking through all directions.  The code grows with the number of
vectors, so filters stay short, and the cap with the code, so a vector is in
about ``FILTERS`` of them.

Vectors of a filter are compared in half precision, which is off by less than
``MARGIN``; what may reach the threshold is then verified in double precision.
Equal directions are compared once, with their number as weight, so a hot
vector is one row.  A filter's vectors are dealt to chunks, and each pair of
chunks is a group of its own, so no group grows with a filter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import stored

BLOCKS = 2
CODES = 64
# Vectors up to which the smallest code is used; beyond it grows with their square root.
CODE_VECTORS = 200_000
# About how many filters a vector is in.
FILTERS = 40
# Directions this close to a vector's best one (in deviations of a score) are taken in any case.
SLACK = 0.6
MARGIN = 0.0015
CHUNK = 512


def code_size(vectors: int) -> int:
    return max(CODES, math.ceil(CODES * math.sqrt(vectors / CODE_VECTORS)))


@functools.lru_cache(maxsize=8)
def _codes(size: int, codes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and the codewords of each part of the space."""
    rng = np.random.default_rng(size)
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    parts = np.array_split(np.arange(size), min(BLOCKS, size))
    words = []
    for part in parts:
        w = rng.standard_normal((codes, len(part)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(len(part) / size))
    return rotation, words


def filters_of(vectors: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every direction that a unit row exceeds the cap with.

    Rows with low scores take the directions within ``SLACK`` of their best.
    """
    n, size = vectors.shape
    rotation, words = _codes(size, codes)
    turned = vectors @ rotation
    share = min(FILTERS / codes ** len(words), 0.5)
    bound = NormalDist().inv_cdf(1 - share) / np.sqrt(size)
    slack = SLACK / np.sqrt(size)
    scores, at = [], 0
    for w in words:
        scores.append(turned[:, at : at + w.shape[1]] @ w.T)
        at += w.shape[1]
    rows = np.arange(n)
    total, code = np.zeros(n), np.zeros(n, np.int64)
    for k, part in enumerate(scores):
        # Best that the parts behind can add: prefixes that cannot reach the cap are cut.
        rest = sum((s.max(axis=1) for s in scores[k + 1 :]), np.zeros(n))
        top = sum(s.max(axis=1) for s in scores)
        need = np.minimum(bound, top - slack)
        added = total[:, None] + part[rows]
        keep = added + rest[rows][:, None] >= need[rows][:, None] - 1e-12
        r, c = np.nonzero(keep)
        total, code, rows = added[r, c], code[r] * codes + c, rows[r]
    return rows, code


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that can be compared, and their unit vectors in double precision."""
    good, out = [], []
    for k, v in enumerate(column):
        if v.is_valid and len(v) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and (biggest := np.abs(x).max()) > 0:
                x = x / biggest
                good.append(k)
                out.append(x / np.sqrt(x @ x))
    return np.array(good, np.int64), out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, units = _unit(batch["vector"])
        bytes_ = [None] * batch.num_rows
        for k, u in zip(good.tolist(), units):
            bytes_[k] = u.tobytes()
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(bytes_, pa.binary())], names=["vec_id", "unit"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _post(codes: int):
    def run(batches):
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                units = _matrix(part["unit"], size)
                rows, code = filters_of(units, codes)
                half = [u.tobytes() for u in units.astype(np.float16)]
                ids = part["cls"].to_numpy(zero_copy_only=False)[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.full(len(rows), size), pa.int32()), pa.array(code), pa.array([half[r] for r in rows.tolist()], pa.binary())],
                    names=["cls", "size", "filter", "half"],
                )

    return run


def _candidates(threshold: float):
    """Pairs of one group that lie in its two chunks and may reach the threshold."""

    def run(group: pa.Table) -> pa.Table:
        size = group["size"][0].as_py()
        x = np.frombuffer(b"".join(group["half"].to_pylist()), np.float16).reshape(-1, size).astype(np.float32)
        ids, own = group["cls"].to_numpy(), group["own"].to_numpy()
        i, j = np.flatnonzero(own == group["i"][0].as_py()), np.flatnonzero(own == group["j"][0].as_py())
        r, c = np.nonzero(x[i] @ x[j].T >= threshold - MARGIN)
        a, b = ids[i[r]], ids[j[c]]
        apart = a < b if group["i"][0] == group["j"][0] else a != b
        return pa.table({"a": np.minimum(a, b)[apart], "b": np.maximum(a, b)[apart]})

    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                good = [float(np.frombuffer(x.as_py()) @ np.frombuffer(y.as_py())) >= threshold for x, y in zip(batch["unit"], batch["other"])]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def linked_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes (cls, size, unit) with a cosine of ``threshold`` or more."""
    posted = classes.select("cls", "size", "unit").mapInArrow(_post(code_size(classes.count())), "cls long, size int, filter long, half binary")
    counts = posted.groupBy("size", "filter").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = posted.join(counts.select("size", "filter", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("chunks")), ["size", "filter"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    # A row meets its own chunk and every other one.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cls", "size", "filter", "half", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    maybe = dealt.groupBy("size", "filter", "i", "j").applyInArrow(_candidates(threshold), "a long, b long").distinct()
    units = classes.select(F.col("cls").alias("a"), "unit")
    both = maybe.join(units, "a").join(units.select(F.col("a").alias("b"), F.col("unit").alias("other")), "b")
    return both.select("a", "b", "unit", "other").mapInArrow(_verify(threshold), "a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Link vectors (vec_id, embedding) with a cosine of ``threshold`` or more.

    Returns one row per row of ``vectors``: vec_id, n_links (other vectors
    linked directly), component_id (smallest vec_id that links reach) and kept
    (vec_id = component_id).

    Defined cases: vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different size don't
    link; equal directions do.  Rows that share a vec_id count as several
    vectors of one id.  Rows without vec_id are left out.  Other columns are
    ignored.
    """
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id is not null")
    described = stored(named.mapInArrow(_describe, "vec_id long, unit binary"), "vectors")
    members = described.filter("unit is not null")
    classes = members.groupBy("unit").agg(F.min("vec_id").alias("cls"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("size", (F.octet_length("unit") / 8).cast("int")), "classes")
    pairs = stored(linked_pairs(classes, threshold), "pairs")

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = classes.select(F.col("cls").alias("b"), "weight")
    outside = both.join(weights, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("weight").alias("outside"))
    joined = components(pairs).withColumnRenamed("node", "cls")
    told = classes.join(outside, "cls", "left").join(joined, "cls", "left")
    told = told.select("unit", (F.col("weight") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = described.join(told, "unit", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
