"""Substring dedup against a plain search of every window."""

import hashlib
import random
import re

import pytest

from checks.compare import difference, duck
from trainlake.llm.queries import QUERIES, SQL
from trainlake.llm.substring import SuffixAutomaton, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, length):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone.update(range(s, s + length))
            seen.add(window)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def corpus(seed=1, letters="abcdefghij", n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(3))
    common = [[word() for _ in range(rng.randint(8, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                passage = list(rng.choice(common))
                if rng.random() < 0.4:
                    passage[rng.randrange(len(passage))] = word()
                words += passage
        if docs and rng.random() < 0.15:
            words = WORD.findall(rng.choice(docs)[1])
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rng.shuffle(docs)
    return docs


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


@pytest.mark.parametrize("length,letters", [(20, "abcdefghij"), (6, "ab"), (2, "a")])
def test_equals_brute_force(spark, length, letters):
    docs = corpus(letters=letters)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(remove_repeats(df, length)) == brute(docs, length)


def test_split_shards(spark, monkeypatch):
    """An anchor with many different surroundings is split by window."""
    import trainlake.llm.substring as m

    monkeypatch.setattr(m, "SHARD_PASSAGES", 2)
    docs = corpus(7)
    assert got(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 12)) == brute(docs, 12)


def test_odd_rows(spark):
    long = " ".join(str(k) for k in range(20_000))
    docs = [(1, None), (2, ""), (3, "a a a a a a a"), (4, "a a a a"), (5, long), (6, long), (7, "x y b   c")]
    rows = [(i, t, 1, "s") for i, t in docs]
    df = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_words int, start string"), 3)
    assert df.columns == ["doc_id", "text", "start", "n_words", "n_removed", "kept_text"]
    assert got(df) == brute(docs, 3)
    kept = remove_repeats(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string"), 2).collect()
    assert [r["n_removed"] for r in kept] == [0, 0]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_knows_substrings():
    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(4)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        probe = "".join(rng.choice("abc") for _ in range(12))
        for end, size in enumerate(automaton.matching(probe), 1):
            longest = max(k for k in range(end + 1) if k == 0 or any(probe[end - k : end] in t for t in texts))
            assert size == longest


def test_query(spark, sf):
    assert difference(QUERIES["op1_substring_dedup"](spark, sf), SQL["op1_substring_dedup"], duck(sf)) is None
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: hashlib.sha256(v[2].encode()).hexdigest() for i, v in brute(docs, 20).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op1_substring_dedup"](spark, sf).collect()} == want
