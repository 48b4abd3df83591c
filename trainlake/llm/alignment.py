"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes; offsets where tokens of both end cut the
bytes into groups, and tokens that share a group are linked.  How many
documents hold each linked id pair is counted outside of memory:

1. Tasks tokenise whole texts and collect (pair, document, times) records.  A
   full buffer becomes a run: sorted, cut by the radix of the pair's A id, and
   written as zstd frames to the shared folder, the pairs with their number of
   documents apart from the documents themselves.
2. Runs of a radix are merged by a k-way heap over their frames, at most
   ``FAN_IN`` at a time, and the merged ones once more, which counts each
   pair.  Pairs come out by A id, so an A id's maximum is known as soon as the
   next one begins.
3. The counts stream back to the runs they came from, in the runs' own order,
   and each run adds them up for its documents.

Only pairs with counts meet, never their documents: a pair that all documents
hold is one record of each run.  The radix is the low bits of the A id, which
spreads the frequent ids of a vocabulary over all radixes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .storage import stored

RADIX_BITS = 6
# Links that one buffer takes before it becomes a run, and documents in a run.
RUN_LINKS = 2_000_000
RUN_DOCUMENTS = 20_000
# Runs merged at a time.
FAN_IN = 64
# Values of one zstd frame.
FRAME = 16_384

_U = np.uint64
_RUN = "run string, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, pairs array<binary>, holders array<binary>, places array<binary>, times array<binary>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(values: np.ndarray, rising: bool = False) -> list[bytes]:
    """Unsigned integers as zstd frames, byte by byte of their width; rising ones as differences."""
    press = zstandard.ZstdCompressor(level=1)
    out = []
    for at in range(0, len(values), FRAME):
        part = values[at : at + FRAME]
        if rising:
            part = np.diff(part, prepend=part.dtype.type(0))
        out.append(press.compress(np.ascontiguousarray(part.view(np.uint8).reshape(len(part), -1).T).tobytes()))
    return out


def frames(packed: list[bytes], kind: type, rising: bool = False) -> Iterator[np.ndarray]:
    """The values of each frame."""
    width = np.dtype(kind).itemsize
    unpress = zstandard.ZstdDecompressor()
    for frame in packed:
        part = np.ascontiguousarray(np.frombuffer(unpress.decompress(frame), np.uint8).reshape(width, -1).T).view(kind).ravel()
        yield np.cumsum(part, dtype=kind) if rising else part


def unpack(packed: list[bytes], kind: type, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *frames(packed, kind, rising)])


def tally(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their times (of ones without)."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if times is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)
    return keys[first], np.add.reduceat(times, first, dtype=np.uint32) if len(first) else times[:0]


class Layout:
    """How an id pair and a document's place in its run share 64 bits, radix first, then by A id."""

    def __init__(self, n_a: int, n_b: int):
        self.a_bits = max((n_a - 1).bit_length(), RADIX_BITS)
        self.b_bits = max((n_b - 1).bit_length(), 1)
        self.doc_bits = 64 - self.a_bits - self.b_bits
        ids = np.arange(n_a, dtype=_U)
        turned = (ids & _U((1 << RADIX_BITS) - 1)) << _U(self.a_bits - RADIX_BITS) | ids >> _U(RADIX_BITS)
        self.side = turned << _U(self.b_bits + self.doc_bits)

    def radix(self, pairs: np.ndarray) -> np.ndarray:
        return pairs >> _U(self.a_bits + self.b_bits - RADIX_BITS)


def _piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """What each id spells: its piece with U+2581 as space, or the byte it stands for."""
    return [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


class Aligner:
    """Tokenises texts with both vocabularies and groups their tokens."""

    def __init__(self, path_a: str, path_b: str, proved: tuple):
        self.a = bytebpe.Encoder(path_a, *proved, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelled = {i: s for s, i in bytebpe.token_bytes(self.a.library).items()}
        n_a = max(self.a.library.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [spelled.get(i, b"") for i in range(n_a)]
        self.bytes_b = _piece_bytes(self.b)
        self.size_a = np.array([len(s) for s in self.bytes_a], np.int64)
        self.size_b = np.array([len(s) for s in self.bytes_b], np.int64)
        self.layout = Layout(n_a, len(self.bytes_b))
        # An id with the mark behind it: inside and at the end of its side of a group.
        numbers = [b"%d" % i for i in range(max(n_a, len(self.bytes_b)))]
        self.marked = {mark: np.array([s + mark for s in numbers], object) for mark in (b",", b"|", b";")}

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a side doesn't spell a space and the text."""
        out_a, out_b = [], []
        for text, a, b in zip(texts, self.a.group([" " + t for t in texts]), self.b.encode(texts, out_type=int, num_threads=1)):
            ids = np.frombuffer(a, np.uint32)
            whole = (" " + text).encode()
            same = text and b"".join([self.bytes_a[i] for i in ids.tolist()]) == whole == b"".join([self.bytes_b[i] for i in b])
            out_a.append(ids if same else ids[:0])
            out_b.append(np.array(b if same else [], np.uint32))
        return out_a, out_b

    def group(self, texts: list[str], first: int) -> tuple[list[list], np.ndarray, np.ndarray]:
        """Rows [n_a, n_b, n_groups, n_links, groups_sha256] of some texts, and their records.

        A record is a distinct (pair, document) key, documents numbered from
        ``first``, with how often the document links the pair.
        """
        each_a, each_b = self._ids(texts)
        a, b = np.concatenate(each_a), np.concatenate(each_b)
        start_a = np.concatenate([[0], np.cumsum([len(x) for x in each_a])])
        start_b = np.concatenate([[0], np.cumsum([len(x) for x in each_b])])
        # Both sides spell the same bytes, so all texts are handled as one; groups end with each text.
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        first_b = np.cumsum(n_b) - n_b
        groups = np.concatenate([[0], np.cumsum(last_a)])[start_a]
        links = np.concatenate([[0], np.cumsum(n_a * n_b)])[groups]

        # Ids in the order in which they are written, each with its mark.
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + first_b[of_a]] = np.where(last_a, self.marked[b"|"][a], self.marked[b","][a])
        written[np.arange(len(b)) + np.cumsum(n_a)[of_b]] = np.where(last_b, self.marked[b";"][b], self.marked[b","][b])
        bounds = start_a + start_b
        rows = []
        for i in range(len(texts)):
            text = b"".join(written[bounds[i] : bounds[i + 1]].tolist())[:-1]
            sha = hashlib.sha256(text).hexdigest() if text else ""
            rows.append([int(x) for x in (start_a[i + 1] - start_a[i], start_b[i + 1] - start_b[i], groups[i + 1] - groups[i], links[i + 1] - links[i])] + [sha])

        # Every A token meets the B tokens of its group, some millions of links at a time.
        document = np.repeat(np.arange(first, first + len(texts), dtype=_U), np.diff(start_a))
        head = self.layout.side[a] | document
        tail = b.astype(_U) << _U(self.layout.doc_bits)
        partners = n_b[of_a]
        ends = np.cumsum(partners)
        keys, times = np.zeros(0, _U), np.zeros(0, np.uint32)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + RUN_LINKS, side="right")))
            here = partners[i:j]
            inside = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
            more, n_more = tally(np.repeat(head[i:j], here) | tail[np.repeat(first_b[of_a[i:j]], here) + inside])
            keys, times = tally(np.concatenate([keys, more]), np.concatenate([times, n_more])) if len(keys) else (more, n_more)
            i = j
        return rows, keys, times


def _run_rows(layout: Layout, keys: list[np.ndarray], times: list[np.ndarray]) -> Iterator[tuple]:
    """(radix, pairs, holders, places, times) of a buffer, as zstd frames."""
    merged, n = tally(np.concatenate(keys), np.concatenate(times))
    pairs = merged >> _U(layout.doc_bits)
    places = (merged & _U((1 << layout.doc_bits) - 1)).astype(np.uint32)
    radix = layout.radix(pairs)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1]])), len(radix))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        distinct, holders = tally(pairs[s:e])
        yield int(radix[s]), pack(distinct, True), pack(holders), pack(places[s:e]), pack(n[s:e])


def spill(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document, and one per run and radix."""
    proved = bytebpe.proof(path_a, plain=True)
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}.get(c.split()[1], pa.list_(pa.binary()))) for c in _RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, proved)
        task, n_runs, n_docs, n_links = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def rows(columns: list[tuple], docs: bool) -> pa.RecordBatch:
            blank = [(None,) * len(columns)]
            filled = list(zip(*columns))
            values = [(f"{task}-{n_runs}",) * len(columns), *(filled + blank * 5 if docs else blank * 7 + filled)]
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            ids = iter(batch["doc_id"].to_pylist())
            for texts in bytebpe.text_groups(batch["text"]):
                found, more, n_more = aligner.group(texts, n_docs)
                yield rows([(n_docs + k, next(ids), *row) for k, row in enumerate(found)], True)
                n_docs += len(texts)
                n_links += len(more)
                keys.append(more)
                times.append(n_more)
                if n_links >= RUN_LINKS or n_docs >= RUN_DOCUMENTS:
                    if n_links:
                        yield rows(list(_run_rows(aligner.layout, keys, times)), False)
                    n_runs, n_docs, n_links, keys, times = n_runs + 1, 0, 0, [], []
        if n_links:
            yield rows(list(_run_rows(aligner.layout, keys, times)), False)
        # The worker lives on for other stages.
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RUN)


def merged(runs: list[tuple[list[bytes], list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way heap merge of runs of (pairs, counts): rising blocks of distinct pairs with summed counts."""
    cursors = [zip(frames(p, _U, True), frames(c, np.uint32)) for p, c in runs]
    blocks = [next(c, None) for c in cursors]
    heap = [(int(block[0][0]), i) for i, block in enumerate(blocks) if block]
    heapq.heapify(heap)
    while heap:
        # All that is known of every run reaches up to the smallest last pair.
        limit = min(int(blocks[i][0][-1]) for _, i in heap)
        parts = []
        while heap and heap[0][0] <= limit:
            i = heapq.heappop(heap)[1]
            pairs, counts = blocks[i]
            cut = int(np.searchsorted(pairs, _U(limit), side="right"))
            parts.append((pairs[:cut], counts[:cut]))
            blocks[i] = (pairs[cut:], counts[cut:]) if cut < len(pairs) else next(cursors[i], None)
            if blocks[i]:
                heapq.heappush(heap, (int(blocks[i][0][0]), i))
        yield tally(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))


def with_maxima(blocks: Iterator[tuple[np.ndarray, np.ndarray]], b_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Add whether each pair's count is its A id's highest; an A id is held until the next begins."""
    pairs, counts = np.zeros(0, _U), np.zeros(0, np.uint32)

    def judged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = pairs >> _U(b_bits)
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
        return pairs, counts, (counts == highest).astype(np.uint8)

    for more, n_more in blocks:
        pairs, counts = np.concatenate([pairs, more]), np.concatenate([counts, n_more])
        side = pairs >> _U(b_bits)
        cut = int(np.searchsorted(side, side[-1]))
        if cut:
            yield judged(pairs[:cut], counts[:cut])
            pairs, counts = pairs[cut:], counts[cut:]
    if len(pairs):
        yield judged(pairs, counts)


def _arrow(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})


_LIST = pa.list_(pa.binary())


def _merge_runs(table: pa.Table) -> pa.Table:
    runs = list(zip(table["pairs"].to_pylist(), table["holders"].to_pylist()))
    pairs, counts = [], []
    for block, n in merged(runs):
        pairs += pack(block, True)
        counts += pack(n)
    return _arrow({"radix": (table["radix"][:1].to_pylist(), pa.int32()), "pairs": ([pairs], _LIST), "holders": ([counts], _LIST)})


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Align the tokens of two tokenizers in every text and count the linked id pairs.

    ``path_a`` is a byte-level BPE file, applied to a space and the text,
    ``path_b`` a sentencepiece model that adds the space itself.  Returns per
    document doc_id, n_a, n_b (tokens), n_groups, n_links (linked token
    pairs), n_best (links whose pair is held by as many documents as any pair
    of its A id), count_sum (holding documents, summed over links) and
    groups_sha256 of ``a1,a2|b1;a3|b2,b3``.

    Defined cases: a null or empty text, or one that either side doesn't spell
    byte by byte, has no tokens: zeros and an empty groups_sha256.  Every row
    is a document, whatever its doc_id; equal texts count as often as they
    occur.  An empty table gives an empty result.  Other columns of ``docs``
    are ignored.
    """
    runs = stored(spill(docs, path_a, path_b), "runs")
    library = bytebpe.load(path_a)
    n_a = max(library.get_vocab(with_added_tokens=True).values()) + 1
    layout = Layout(n_a, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    b_bits = layout.b_bits

    heads = runs.filter("radix is not null")
    most = heads.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    shares = max(1, -(-most // FAN_IN))
    heads = heads.withColumn("share", F.pmod(F.xxhash64("run"), F.lit(shares)).cast("int"))

    def totals_of(table: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for pairs, counts, best in with_maxima(merged(list(zip(table["pairs"].to_pylist(), table["holders"].to_pylist()))), b_bits):
            for column, packed in zip(out, (pack(pairs, True), pack(counts), pack(best))):
                column += packed
        return _arrow({"radix": (table["radix"][:1].to_pylist(), pa.int32()), "pairs": ([out[0]], _LIST), "holders": ([out[1]], _LIST), "best": ([out[2]], _LIST)})

    def back(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = next(r for r in rows if r["run"] is None)
        pairs, counts, best = unpack(total["pairs"], _U, True), unpack(total["holders"], np.uint32), unpack(total["best"], np.uint8)
        found = [(r["run"], r["radix"], np.searchsorted(pairs, unpack(r["pairs"], _U, True))) for r in rows if r["run"] is not None]
        return _arrow(
            {
                "run": ([run for run, _, _ in found], pa.string()),
                "radix": ([radix for _, radix, _ in found], pa.int32()),
                "counts": ([pack(counts[at]) for _, _, at in found], _LIST),
                "best": ([pack(best[at]) for _, _, at in found], _LIST),
            }
        )

    def added_up(table: pa.Table) -> pa.Table:
        is_doc = pc.is_valid(table["doc"])
        rows = table.filter(is_doc).sort_by("doc")
        best, sums = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        bodies: dict[int, dict] = {}
        for r in table.filter(pc.invert(is_doc)).select(["radix", "holders", "places", "times", "counts", "best"]).to_pylist():
            bodies.setdefault(r["radix"], {}).update({k: v for k, v in r.items() if v is not None})
        for r in bodies.values():
            holders, places, times = (unpack(r[c], np.uint32) for c in ("holders", "places", "times"))
            counts, highest = unpack(r["counts"], np.uint32), unpack(r["best"], np.uint8)
            times = times.astype(np.int64)
            np.add.at(best, places, times * np.repeat(highest, holders))
            np.add.at(sums, places, times * np.repeat(counts, holders))
        kept = {name: rows[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(kept | {"n_best": pa.array(best), "count_sum": pa.array(sums), "groups_sha256": rows["groups_sha256"]})

    part = "radix int, pairs array<binary>, holders array<binary>"
    shared = heads.select("radix", "share", "pairs", "holders").groupBy("radix", "share").applyInArrow(_merge_runs, part)
    totals = stored(shared.groupBy("radix").applyInArrow(totals_of, part + ", best array<binary>"), "totals")
    dealt = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asked = heads.select("run", "radix", "share", "pairs").unionByName(dealt, allowMissingColumns=True)
    # A share without runs has nothing to answer.
    counts = asked.groupBy("radix", "share").applyInArrow(back, "run string, radix int, counts array<binary>, best array<binary>")
    return runs.drop("pairs").unionByName(counts, allowMissingColumns=True).groupBy("run").applyInArrow(added_up, _RESULT)
