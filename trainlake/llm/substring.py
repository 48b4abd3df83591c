"""Substring dedup with suffix automata of reference shards.

A window is ``length`` consecutive words of one document.  A word goes when a
window over it has the same words as a window that starts earlier (smaller
doc_id, or same document and earlier start).

1. Every window elects the smallest hash among its ``GRAM``-word grams, its
   anchor.  Equal windows elect equal anchors, and about one word in eight
   becomes one.  Neighbouring windows with one anchor form a passage.
2. Only passages whose anchor occurs again go on.  Passages with equal words
   (128 bits of hash) form a class; all but its first passage are repeats.
3. Classes that differ but share an anchor can still share windows.  Their
   first passages are the reference, sharded by anchor: a shard's passages are
   streamed in corpus order through the suffix automaton of those before them.
   Where the matching statistic reaches ``length``, the window is a repeat.
   An anchor with very many classes is split by the windows' own hash.

The automata of all shards grow with the corpus, so no broadcast could hold
them; and streaming every document through every shard is quadratic.  A shard
is therefore built in the task that holds it, and only passages with its
anchors, the only ones that can match, are sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored, unused
from .words import mix, pieces, runs

LENGTH = 20
GRAM = 5
# Passages that one automaton holds on average at most; more are split by window.
SHARD_PASSAGES = 1024

_DIGEST_BASE = int(np.random.default_rng(21).integers(1, 2**63)) * 2 + 1


def _passages(length: int):
    """Per document: anchor, word digest, first window and number of windows of its passages."""
    gram = min(GRAM, length)
    width = length - gram + 1
    bits = np.uint64(max(width - 1, 1).bit_length())
    low = np.uint64((1 << int(bits)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, words in pieces(batch["text"]):
                counts = np.diff(words.first)
                windows = np.maximum(counts - length + 1, 0)
                total = int(windows.sum())
                if total == 0:
                    continue
                doc = np.repeat(np.arange(j - i), windows)
                base = np.cumsum(windows) - windows
                start = np.arange(total) - base[doc]
                at = words.first[doc] + start
                grams = words.grams(gram)
                coarse = grams & ~low
                best = coarse[at]
                for k in range(1, width):
                    np.minimum(best, coarse[at + k] | np.uint64(k), out=best)
                chosen = at + (best & low).astype(np.int64)
                new = np.ones(total, bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, total))
                digest = mix(runs(mix(words.hashes ^ np.uint64(0x5BD1E995)), _DIGEST_BASE, at[head], at[head] + n + length - 1) + n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[chosen[head]].view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ids[i:j][doc[head]], pa.int64()), pa.array(start[head], pa.int32()), pa.array(n, pa.int32())],
                    names=["anchor", "digest", "doc_id", "start", "n"],
                )

    return run, "anchor long, digest long, doc_id long, start int, n int"


def _reference(length: int):
    """The words of the asked passages, whole, or by window for anchors in several shards."""

    def run(batches):
        for batch in batches:
            out = {"anchor": [], "shard": [], "doc_id": [], "start": [], "words": []}
            wanted = batch["asked"].to_pylist()
            for i, j, words in pieces(batch["text"]):
                whole = words.grams(length)
                raw = words.bytes.tobytes()
                for k in range(j - i):
                    f = int(words.first[k])
                    doc_id = batch["doc_id"][i + k].as_py()
                    for ask in wanted[i + k]:
                        if ask["shards"] == 1:
                            spans = [(ask["start"], ask["n"], 0)]
                        else:
                            spans = [(s, 1, int(whole[f + s] % np.uint64(ask["shards"]))) for s in range(ask["start"], ask["start"] + ask["n"])]
                        for s, n, shard in spans:
                            out["anchor"].append(ask["anchor"])
                            out["shard"].append(shard)
                            out["doc_id"].append(doc_id)
                            out["start"].append(s)
                            out["words"].append(raw[words.start[f + s] : words.end[f + s + n + length - 2]])
            kinds = {"anchor": pa.int64(), "shard": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "words": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return run, "anchor long, shard long, doc_id long, start int, words binary"


class SuffixAutomaton:
    """All substrings of the sequences added so far (state 0 is the empty one)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state for p's substrings followed by ``symbol``, taken out of q if q has longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = self._split(last, known, symbol)
                continue
            state, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                self.link[state] = self._split(p, self.next[p][symbol], symbol)
            last = state

    def matching(self, sequence) -> list[int]:
        """Per position, the length of the longest known substring that ends there."""
        out, state, size = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            out.append(size)
        return out


def _stream(length: int):
    """Sorted reference passages through their shards: runs of repeated windows."""

    def run(batches):
        shard, automaton = None, SuffixAutomaton()
        for batch in batches:
            out = {"doc_id": [], "start": [], "n": []}
            for anchor, part, doc_id, start, words in zip(*(batch[c].to_pylist() for c in ("anchor", "shard", "doc_id", "start", "words"))):
                if shard != (anchor, part):
                    shard, automaton = (anchor, part), SuffixAutomaton()
                sequence = words.split()
                ends = [k for k, size in enumerate(automaton.matching(sequence)) if size >= length]
                for k in ends:
                    out["doc_id"].append(doc_id)
                    out["start"].append(start + k - length + 1)
                    out["n"].append(1)
                automaton.add(sequence)
            kinds = {"doc_id": pa.int64(), "start": pa.int32(), "n": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return run, "doc_id long, start int, n int"


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, n): n consecutive windows from word ``start`` on occur earlier in the corpus."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    run, schema = _passages(length)
    passages = docs.mapInArrow(run, schema)
    again = passages.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor")
    again = stored(passages.join(again, "anchor"), "passages")

    classes = again.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start", "n")).alias("f"), F.count("*").alias("k"))
    classes = stored(classes.select("anchor", "digest", F.col("f.doc_id").alias("f_doc"), F.col("f.start").alias("f_start"), F.col("f.n").alias("n"), "k"), "classes")
    later = again.join(classes.filter("k > 1").select("anchor", "digest", "f_doc", "f_start"), ["anchor", "digest"])
    later = later.filter("doc_id != f_doc or start != f_start").select("doc_id", "start", "n")

    several = classes.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1")
    shards = F.ceil(F.col("c") / F.lit(SHARD_PASSAGES)).alias("shards")
    asked = classes.join(several.select("anchor", shards), "anchor")
    asked = asked.groupBy(F.col("f_doc").alias("doc_id")).agg(F.collect_list(F.struct("anchor", F.col("f_start").alias("start"), "n", "shards")).alias("asked"))
    run, schema = _reference(length)
    reference = docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, schema)
    run, schema = _stream(length)
    shared = reference.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "doc_id", "start").mapInArrow(run, schema)
    return later.unionByName(shared)


@F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]))
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Words of each text without those in [start, end) of its spans."""
    n_words, n_removed, kept = [], [], []
    for t, cut in zip(text, spans):
        words = (t.as_py() or "").encode().split()
        n_words.append(len(words))
        keep = words
        if cut.is_valid:
            stay = np.ones(len(words), bool)
            for span in cut.as_py():
                stay[span["start"] : span["end"]] = False
            keep = [w for w, s in zip(words, stay.tolist()) if s]
        n_removed.append(len(words) - len(keep))
        kept.append(b" ".join(keep).decode())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents without the words that repeat earlier passages of ``length`` words or more.

    Returns the columns of ``docs`` and n_words, n_removed and kept_text (the
    remaining words joined by one space); input columns of these names are
    replaced.

    Defined cases: words are unchanged runs of ``[^\\x20\\x09-\\x0D]``; null and
    empty texts have none; texts shorter than ``length`` words keep all.  Of
    equal texts the one with the smallest doc_id stays whole.  Rows that share
    a doc_id count as one document with equal positions: their passages are
    judged together, and what goes from one goes from all.  Rows without
    doc_id are kept whole and are no reference.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = repeated_windows(docs, length)
    listed, cut_to = unused("_spans", docs), unused("_cut", docs)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + F.lit(length - 1)).alias("end"))).alias(listed))
    cut = docs.join(spans, "doc_id", "left").withColumn(cut_to, _without("text", listed))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], f"{cut_to}.n_words", f"{cut_to}.n_removed", f"{cut_to}.kept_text")
