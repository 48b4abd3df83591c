"""Spelling variants by finite-state composition.

Words one edit apart are the pairs that the vocabulary's acceptor, a one-edit
transducer and the acceptor again accept in composition.  The composition is
enumerated per partition of its initial states:

* Let m be the shorter length and h = m // 2.  Words whose first difference
  lies at h or later share their first h characters; others share the last
  m - h.  So every word is listed under its beginning and its end, for m its
  own length and one less, and each pair lies in exactly one list.
* The rests of a list make two minimised acceptors (words of m and of m + 1
  characters) over one set of states.  Before the edit both tapes are in states
  reached by the same string, after it they read equal rests: equal states
  accept them all at once, others are walked in step.
* A list of more than ``LIST_WORDS`` words is split further, into one list for
  each place of the edit and all characters around it.  Such a list holds at
  most one word for each character of the alphabet, whatever the vocabulary.

A list hands on one row per word, its number of near words and the best of
them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

LETTERS = r"[a-zÀ-ÿ]+"
LIST_WORDS = 4_000
# Accepted pairs held at a time.
PAIRS = 500_000


def vocabulary(docs: DataFrame, least_chars: int, least_count: int, every: int) -> DataFrame:
    """word and n: how often each word occurs, after the fixed deletions."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_chars)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.pmod(h, F.lit(every)) == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _key(*parts: Column) -> Column:
    """128 bits that stand for a list."""
    return F.unhex(F.md5(F.concat_ws("\x00", *parts).cast("binary")))


def _lists(words: DataFrame) -> DataFrame:
    """Each word under its four lists: key, rest, longer (the word has m + 1 characters), end (the list shares ends), m."""
    word, n = F.col("word"), F.length("word")

    def entry(m: Column, end: bool) -> Column:
        h = F.floor(m / 2).cast("int")
        cut = (n - (m - h)) if end else h
        first, last = F.substring(word, F.lit(1), cut), F.substring(word, cut + 1, n)
        shared, rest = (last, first) if end else (first, last)
        return F.struct(_key(F.lit("end" if end else "begin"), m.cast("string"), shared).alias("key"), rest.alias("rest"), (n > m).alias("longer"), F.lit(end).alias("end"), m.cast("int").alias("m"))

    entries = F.array(*(entry(m, end) for m in (n, n - 1) for end in (False, True)))
    return words.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.*")


def _places(rows: DataFrame) -> DataFrame:
    """Rows of long lists under one key for each place of the edit."""
    word, n, i = F.col("word"), F.length("word"), F.col("i")
    h = F.floor(F.col("m") / 2).cast("int")
    low, high = F.when(F.col("end"), 0).otherwise(h), F.when(F.col("end"), h - 1).otherwise(F.col("m"))
    placed = rows.filter(low <= high).withColumn("i", F.explode(F.sequence(low, high)))
    before, at, behind = F.substring(word, F.lit(1), i), F.substring(word, i + 1, F.lit(1)), F.substring(word, i + 2, n)
    replaced = F.struct(_key(F.lit("replaced"), i.cast("string"), before, behind).alias("key"), at.alias("rest"), F.lit(False).alias("longer"))
    # The last place that gives the shorter word: a character equal to the next one is deleted there.
    deleted = F.struct(_key(F.lit("deleted"), i.cast("string"), before, behind).alias("key"), at.alias("rest"), F.lit(True).alias("longer"))
    kept = F.struct(_key(F.lit("deleted"), i.cast("string"), before, F.substring(word, i + 1, n)).alias("key"), F.lit("").alias("rest"), F.lit(False).alias("longer"))
    short = F.when(i < n, F.array(replaced, kept)).otherwise(F.array(kept))
    long = F.when(at != F.substring(word, i + 2, F.lit(1)), F.array(deleted)).otherwise(F.array().cast("array<struct<key:binary,rest:string,longer:boolean>>"))
    entry = F.explode(F.when(F.col("longer"), long).otherwise(short)).alias("e")
    return placed.select("word", "n", entry).select("word", "n", "e.*", F.lit(False).alias("end"))


class States:
    """States of minimised acyclic acceptors; equal ones are the same state."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.final)
            # With each arc, how many accepted strings come before it in order.
            before, steps = int(final), {}
            for c, to in arcs:
                steps[c] = (to, before)
                before += self.size[to]
            self.final.append(final)
            self.next.append(steps)
            self.size.append(before)
        return state

    def acceptor(self, words: list[str]) -> int:
        """Initial state for sorted distinct strings."""
        path: list[list] = [[False, []]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, arcs)))

        for word in words:
            same = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        return self._state(*path[0])

    def _equal_rests(self, p: int, q: int, x: int, y: int, skip: str, left: list[int], right: list[int]) -> None:
        """Numbers, from x and y on, of strings that both states accept; none that begins with ``skip``."""
        todo = [(p, q, x, y, skip)]
        while todo:
            p, q, x, y, skip = todo.pop()
            if p == q and not skip:
                left.extend(range(x, x + self.size[p]))
                right.extend(range(y, y + self.size[p]))
                continue
            if self.final[p] and self.final[q]:
                left.append(x)
                right.append(y)
            there = self.next[q]
            for c, (to, n) in self.next[p].items():
                if c != skip and c in there:
                    other, m = there[c]
                    todo.append((to, other, x + n, y + m, ""))

    def one_edit(self, long: int | None, short: int, end: bool) -> Iterator[tuple[list[int], list[int], bool]]:
        """Pairs one edit apart as numbers, with whether the left one is the longer.

        First pairs of ``short`` with one character replaced, smaller number
        left; then strings of ``long`` with those of ``short`` that lack one
        character, at the last place that gives them.  With ``end`` that place
        isn't behind the shorter string.
        """
        left: list[int] = []
        right: list[int] = []
        todo = [(short, 0)]
        while todo:
            q, x = todo.pop()
            arcs = list(self.next[q].items())
            for k, (_, (p1, n1)) in enumerate(arcs):
                todo.append((p1, x + n1))
                for _, (p2, n2) in arcs[k + 1 :]:
                    self._equal_rests(p1, p2, x + n1, x + n2, "", left, right)
            if len(left) >= PAIRS:
                yield left, right, False
                left, right = [], []
        yield left, right, False
        if long is None:
            return
        left, right = [], []
        both = [(long, short, 0, 0)]
        while both:
            p, q, x, y = both.pop()
            there = self.next[q]
            for c, (to, n) in self.next[p].items():
                if not (end and self.final[q]):
                    self._equal_rests(to, q, x + n, y, c, left, right)
                if c in there:
                    other, m = there[c]
                    both.append((to, other, x + n, y + m))
            if len(left) >= PAIRS:
                yield left, right, True
                left, right = [], []
        yield left, right, True


def near_in_list(rests: list[str], longer: list[bool], words: list[str], counts: list[int], end: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of its near words, n of the best, the best) for the words of one list that have any."""
    sides = [sorted((r, k) for k, (r, is_long) in enumerate(zip(rests, longer)) if is_long == side) for side in (False, True)]
    if not sides[0] or len(rests) < 2:
        return
    states = States()
    short = states.acceptor([r for r, _ in sides[0]])
    long = states.acceptor([r for r, _ in sides[1]]) if sides[1] else None
    numbers = [np.array([k for _, k in side], np.int64) for side in sides]
    # The best word has the largest n, then comes first in code-point order.
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    n_near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for left, right, deleted in states.one_edit(long, short, end):
        x, y = numbers[int(deleted)][np.array(left, np.int64)], numbers[0][np.array(right, np.int64)]
        for a, b in ((x, y), (y, x)):
            n_near += np.bincount(a, minlength=len(words))
            np.minimum.at(best, a, rank[b])
    for k in np.flatnonzero(n_near).tolist():
        top = order[best[k]]
        yield words[k], int(n_near[k]), counts[top], words[top]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best of every word with near words; ``words`` is a stored table of word and n."""
    lists = _lists(words)
    long = lists.groupBy("key").count().filter(F.col("count") > LIST_WORDS).select("key", F.lit(True).alias("long"))
    marked = lists.join(long, "key", "left")
    columns = ("key", "rest", "longer", "end", "word", "n")
    whole = marked.filter("long is null").select(*columns)
    split = _places(marked.filter("long")).select(*columns)
    # Lists of one word have no pairs, and needn't be sorted or sent to Python in order of size.
    dealt = whole.unionByName(split).repartition("key").sortWithinPartitions("key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=["word", "n_near", "best_n", "best"])

        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            members = list(group)
            if len(members) > 1:
                _, rests, longer, end, spelled, counts = zip(*members)
                held.extend(near_in_list(list(rests), list(longer), list(spelled), list(counts), end[0]))
            if len(held) >= 10_000:
                yield batch()
                held = []
        if held:
            yield batch()

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return summed.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """word and root: the end of each chain of (word, form).

    A form is at least ``ratio`` times as frequent as its word, so chains end;
    each round doubles the steps taken.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, least_chars: int = 7, least_count: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """Group the words of all texts by spelling.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased; a
    run whose crc32 of ``<doc_id>:<run>`` is a multiple of ``every`` loses the
    character at that number modulo its length.  Kept are words of at least
    ``least_chars`` characters that occur ``least_count`` times.  Two words are
    near if one inserted, deleted or replaced character turns one into the
    other.  A word's form is the near word with the largest n (ties: smallest
    in code-point order) if that is at least ``ratio`` times the word's own n.

    Returns word, form, root (the end of the word's chain of forms), n, n_near
    and form_n.

    Defined cases: null and empty texts have no words; a null doc_id counts as
    an empty one in the hash; repeated rows count as often as they occur; an
    empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    words = stored(vocabulary(docs, least_chars, least_count, every), "words")
    near = stored(near_words(words), "near")
    judged = words.join(near, "word", "left").withColumn("has_form", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    chains = words.join(near, "word").filter(F.col("best_n") >= ratio * F.col("n")).select("word", F.col("best").alias("form"))
    return judged.join(follow(chains), "word", "left").select(
        "word",
        F.when(F.col("has_form"), F.col("best")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("has_form"), F.col("best_n")).alias("form_n"),
    )
