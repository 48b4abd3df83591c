"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets form one class.  Each class is posted under
its (coordinate, value) pairs.  A pair of classes that agrees on at least
``MATCHES`` of ``COORDINATES`` agrees on one of the first
``COORDINATES - MATCHES + 1`` of them in any common order, so only that prefix
is posted, rarest values first (frequencies of all documents, kept in a sketch
of fixed size); lists of one class are skipped.

Collisions are counted where the list is: a task holds a list as a matrix of
signatures, counts the agreements of all its pairs and hands on no pairs, but
for each set of classes that pairs above the threshold connect one row per
class, with the smallest.  What these rows connect over all lists is a
candidate group.

Every pair above the threshold lies in one group, so a text is read once more
only, with its group: there the full sets are compared exactly through an
inverted index, skipping pairs that are linked already, and again only links
that connect something are handed on.

Lists and groups larger than a chunk are dealt to chunks, and any two chunks
meet in a task of their own; nothing is left out, and no task holds more than
two chunks.

Limit: links are found with the probability that signatures give.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import forget, stored
from .words import mix, pieces, shingle_sets

COORDINATES = 64
# At similarity 0.8 the matches have mean 51.2 and deviation 3.2.
MATCHES = 36
# Keys of a class that are posted.
PREFIX = COORDINATES - MATCHES + 1
# Classes of a list, and shingles of a group, that a task holds as one chunk.
LIST_CLASSES = 2_000
GROUP_SHINGLES = 1_000_000
# Buckets of the frequency sketch that is sent to all tasks (2 MB).
SKETCH = 1 << 18

_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, COORDINATES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signature of each set; sets without elements have zeros."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, COORDINATES), np.uint32)
    if len(full):
        at = offsets[:-1][full]
        for k, m in enumerate(_MULTIPLIERS):
            out[full, k] = np.minimum.reduceat((values * m) >> np.uint64(32), at).astype(np.uint32)
    return out


def _describe(n_words: int):
    schema = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in pieces(batch["text"], lower=True):
                values, offsets = shingle_sets(words, n_words)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(s)))]) for s in (7, 77)]
                d1, d2 = [(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]
                sigs = signatures(values, offsets)
                ids = batch["doc_id"].slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(offsets), pa.int64()), pa.array(d1), pa.array(d2), pa.array([s.tobytes() for s in sigs], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return run, schema


def _keys(sig: pa.Array) -> np.ndarray:
    """(coordinate, value) pairs as one number each, a row per signature."""
    sigs = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return sigs.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) & np.uint64(SKETCH - 1)).astype(np.int64)


def _frequencies(classes: DataFrame) -> np.ndarray:
    """How often values of each sketch bucket occur over all classes; fixed size."""

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_bucket(_keys(batch["sig"])).ravel(), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = classes.select("sig").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _ordered(sig: pa.Array, frequencies: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rarest keys of each signature, rarest first; the order is the same for all classes."""
    keys = _keys(sig)
    order = np.argsort(frequencies[_bucket(keys)], axis=1, kind="stable")[:, :n]
    return np.take_along_axis(keys, order, 1)


def _postings(classes: DataFrame, frequencies) -> DataFrame:
    """(key, cls) of the rarest keys."""

    def post(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = _ordered(batch["sig"], frequencies.value, PREFIX)
            ids = np.repeat(batch["cls"].to_numpy(zero_copy_only=False), PREFIX)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(post, "key long, cls long")


def _dealt(df: DataFrame, group: str, chunks: Column, salt: Column) -> DataFrame:
    """Rows of each group under every two chunks that meet (``lo``, ``hi``), with their own (``side``), grouped and in order."""
    own = df.withColumns({"chunks": chunks.cast("int"), "side": F.pmod(salt, chunks).cast("int")})
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = other.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("chunks", "other")
    return met.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _runs(batches: Iterator[pa.RecordBatch], group: str, columns: Sequence[str]) -> Iterator[tuple[bool, list[list]]]:
    """(whether two chunks meet, the columns' values) of each consecutive group."""
    held: list[list] = [[] for _ in columns]
    key: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = [batch[c].to_numpy(zero_copy_only=False) for c in (group, "lo", "hi")]
        new = np.zeros(batch.num_rows, bool)
        for x in ids:
            new[1:] |= x[1:] != x[:-1]
        values = [batch[c].to_pylist() for c in columns]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(x[s].item() for x in ids)
            if key is not None and now != key:
                yield key[1] != key[2], held
                held = [[] for _ in columns]
            key = now
            for column, v in zip(held, values):
                column.extend(v[s:e])
    if key is not None:
        yield key[1] != key[2], held


def _pairs_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def connected(near: np.ndarray) -> list[np.ndarray]:
    """Sets of two or more that a symmetric matrix connects."""
    left = np.ones(len(near), bool)
    out = []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        if not left[i]:
            continue
        reached, todo = np.zeros(len(near), bool), [i]
        reached[i] = True
        while todo:
            fresh = near[todo].any(axis=0) & ~reached
            reached |= fresh
            todo = np.flatnonzero(fresh).tolist()
        left &= ~reached
        out.append(np.flatnonzero(reached))
    return out


def agreements(sigs: np.ndarray) -> np.ndarray:
    """On how many coordinates any two signatures agree."""
    same = np.empty((len(sigs), len(sigs)), np.uint8)
    step = max(1, 4_000_000 // (len(sigs) * COORDINATES))
    for at in range(0, len(sigs), step):
        same[at : at + step] = (sigs[at : at + step, None, :] == sigs[None, :, :]).sum(axis=2)
    return same


def _candidates(classes: DataFrame) -> DataFrame:
    """(a, b): what pairs with ``MATCHES`` agreements connect inside each list, as links to its smallest class."""
    frequencies = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))
    postings = _postings(classes, frequencies)
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")

    def low_bytes(batches):
        # One byte per coordinate is enough here: equal values stay equal, few others become so.
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).astype(np.uint8).tobytes()
            short = pa.array([sigs[k : k + COORDINATES] for k in range(0, len(sigs), COORDINATES)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["cls"], short], names=["cls", "sig"])

    def count(batches):
        a: list[int] = []
        b: list[int] = []
        for two, (ids, sigs, sides) in _runs(batches, "key", ["cls", "sig", "side"]):
            near = agreements(np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, COORDINATES)) >= MATCHES
            np.fill_diagonal(near, False)
            if two:
                near &= np.not_equal.outer(sides, sides)
            for found in connected(near):
                members = [ids[k] for k in found]
                smallest = min(members)
                b.extend(m for m in members if m != smallest)
                a.extend([smallest] * (len(b) - len(a)))
            if len(a) >= 10_000:
                yield _pairs_batch(a, b)
                a, b = [], []
        yield _pairs_batch(a, b)

    listed = postings.join(sizes, "key").join(classes.select("cls", "sig").mapInArrow(low_bytes, "cls long, sig binary"), "cls")
    dealt = _dealt(listed, "key", F.ceil(F.col("n") / LIST_CLASSES), F.xxhash64("cls"))
    return dealt.select("key", "lo", "hi", "cls", "sig", "side").mapInArrow(count, "a long, b long").distinct()


def linking_pairs(sets: Sequence[np.ndarray], p: int, q: int, sides: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all pairs with Jaccard similarity p/q or more connect.

    With ``sides`` only pairs of different sides count.  A set in the largest
    component is held against the others only by them, so most of a large
    group of copies is never compared with itself.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(of, kind="stable")]
    start = np.cumsum(count) - count
    first = np.cumsum(size) - size
    side = None if sides is None else np.asarray(sides)
    label, members = np.arange(n), np.ones(n, np.int64)
    waiting = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    while True:
        largest = int(members.argmax())
        todo = np.flatnonzero(waiting & (label != largest))
        if not len(todo):
            return out
        i = int(todo[0])
        waiting[i] = False
        mine = of[first[i] : first[i] + size[i]]
        here = count[mine]
        at = np.repeat(start[mine] - (np.cumsum(here) - here), here) + np.arange(here.sum())
        shared = np.bincount(holders[at], minlength=n)
        linked = (q * shared >= p * (size[i] + size - shared)) & (label != label[i])
        if side is not None:
            linked &= side != side[i]
        while linked.any():
            j = int(np.flatnonzero(linked)[0])
            out.append((i, j))
            old, new = int(label[j]), int(label[i])
            members[new] += members[old]
            members[old] = 0
            label[label == old] = new
            linked &= label != new


def _links(docs: DataFrame, groups: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(a, b): links on full sets, as many as connect all that is linked.

    ``groups`` has node, component and n_shingles.
    """
    sizes = groups.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    # The ids grow with the corpus, so they are not sent to every task even where they are few.
    texts = groups.join(sizes, "component").join(docs.withColumnRenamed("doc_id", "node").hint("merge"), "node")
    dealt = _dealt(texts, "component", F.ceil(F.col("total") / GROUP_SHINGLES), F.xxhash64("node"))

    def compare(batches):
        a: list[int] = []
        b: list[int] = []
        for two, (ids, held, sides) in _runs(batches, "component", ["node", "text", "side"]):
            sets, kept = [], []
            for i, j, words in pieces(pa.array(held, pa.string()), lower=True):
                values, offsets = shingle_sets(words, n_words)
                for k in range(j - i):
                    # Rows that share a doc_id may hold a text without words.
                    if offsets[k + 1] > offsets[k]:
                        sets.append(values[offsets[k] : offsets[k + 1]])
                        kept.append(i + k)
            if len(sets) > 1:
                for x, y in linking_pairs(sets, percent, 100, [sides[k] for k in kept] if two else None):
                    a.append(ids[kept[x]])
                    b.append(ids[kept[y]])
            if len(a) >= 10_000:
                yield _pairs_batch(a, b)
                a, b = [], []
        yield _pairs_batch(a, b)
        # The worker lives on for other stages.
        pa.default_memory_pool().release_unused()

    return dealt.select("component", "lo", "hi", "node", "text", "side").mapInArrow(compare, "a long, b long").distinct()


def _shared_ids(described: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): rows of one doc_id that lie in several classes are one document."""
    digest = F.struct("d1", "d2")
    several = described.groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).filter("least != most")
    rows = described.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct()
    return rows.join(classes.select("d1", "d2", "cls"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

    Returns one row per row of ``docs`` (columns ``doc_id``, ``text``; others
    are ignored) with doc_id, n_shingles, component_id (the smallest doc_id
    that links reach) and kept (doc_id = component_id).

    Defined cases: words are lower-cased (A-Z); a text with fewer words than
    ``n_words`` has its whole sequence as one shingle; a text without words, or
    null, has no shingle and is alone.  Rows that share a doc_id are one
    document.  Rows without doc_id are left out.  An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    run, schema = _describe(n_words)
    described = stored(docs.mapInArrow(run, schema), "signatures")
    some = described.filter("n_shingles > 0")
    # A class is named by its smallest document, whose text stands for it.
    first = (F.min("doc_id").alias("cls"), F.min("n_shingles").alias("n_shingles"), F.min_by("sig", "doc_id").alias("sig"))
    classes = stored(some.groupBy("d1", "d2").agg(*first), "classes")

    candidates = stored(_candidates(classes), "candidates")
    shingles = classes.groupBy(F.col("cls").alias("node")).agg(F.sum("n_shingles").alias("n_shingles"))
    groups = stored(components(candidates).join(shingles, "node"), "groups")
    forget(candidates)
    links = stored(_links(docs, groups, n_words, percent), "links")
    forget(groups)
    joined = components(links.unionByName(_shared_ids(some, classes)))

    named = classes.select("d1", "d2", "cls").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.select("d1", "d2", F.coalesce("component", "cls").alias("component_id"))
    out = described.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
