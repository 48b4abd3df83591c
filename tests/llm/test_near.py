"""Near-dedup against a brute-force comparison of all pairs."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trainlake.llm import near
from trainlake.llm.components import components
from trainlake.llm.near import near_duplicates
from trainlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, n, percent=80):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, n))
    own = {i: i for i in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                own[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def family(seed=4):
    """A base text, copies of it with many edits, and copies of the copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, i = [], 0
    for _ in range(6):
        base = [word() for _ in range(120)]
        texts = [base]
        for _ in range(25):
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1, 1, 1])] = [word()] * rng.choice([0, 1, 1, 1])
            texts.append(t)
        for t in texts:
            docs.append((i, " ".join(t)))
            i += 1
    rng.shuffle(docs)
    return docs


def result(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def test_families_equal_brute_force(spark):
    docs = family()
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    assert result(got) == brute(docs, 2)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (8, long + " end"), (9, "A b"), (9, "A b"), (None, "x y"), (10, "Äb c"), (11, "äb c")]
    rows = [(i, t, "z", "q") for i, t in docs]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cls string, component string"), 2)
    assert got.count() == 12
    assert result(got) == brute([d for d in docs if d[0] is not None], 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def test_query_on_small_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_minhash_near_dedup"](spark, sf)
    assert result(got) == brute(docs, 2)
    assert {r["doc_id"]: r["n_shingles"] for r in got.collect()} == {i: len(shingles(t, 2)) for i, t in docs}


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def shared_leader(seed, n):
    """Near copies in pairs, all made of a few hundred shingles or of common passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(16)]
    passages = [[f"p{j}q{k}" for k in range(12)] for j in range(40)]
    docs = []
    for k in range(n):
        if k % 2:
            t = [rng.choice(vocabulary) for _ in range(60)]
        else:
            t = [w for j in rng.sample(range(40), 6) for w in passages[j]]
        copy = list(t)
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs += [t, copy]
    rng.shuffle(docs)
    return [(k, " ".join(t)) for k, t in enumerate(docs)]


def test_recurring_shingles_equal_brute_force(spark):
    docs = shared_leader(5, 1000)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    assert result(got) == brute(docs, 2)


def loose(seed, edits, n=150, words=200):
    """Copies of one text, which is not among them, about as far from each other as links reach."""
    rng = random.Random(seed)
    texts = []
    for c in range(n):
        t = [f"s{seed}b{k}" for k in range(words)]
        for at in rng.sample(range(words), rng.choice(edits)):
            t[at] = f"s{seed}c{c}n{at}"
        texts.append(" ".join(t))
    return texts


def test_loose_families_equal_brute_force(spark):
    docs = list(enumerate(loose(2, [7]) + loose(3, [7, 8]) + loose(4, [7]) + loose(7, [10, 11], words=300)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    assert result(got) == brute(docs, 2)


def test_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "LIST_CLASSES", 7)
    monkeypatch.setattr(near, "GROUP_SHINGLES", 900)
    docs = list(enumerate(loose(2, [7], n=60) + loose(3, [7, 8], n=40))) + [(1000 + k, t) for k, t in shared_leader(6, 100)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    assert result(got) == brute(docs, 2)


def test_rows_of_one_id_are_one_document(spark):
    docs = [(1, "a b c"), (3, "a b c"), (3, "x y z"), (4, "x y z"), (3, None), (8, "u v"), (9, "a b"), (9, "p q"), (9, "r s"), (7, "r s")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).filter("n_shingles > 0")
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == set(brute([d for d in docs if d[1]], 2).items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=9), min_size=1, max_size=14), st.booleans())
def test_linking_pairs_connect_all_links(sets, two):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sides = [k % 2 for k in range(len(sets))] if two else None
    linked = lambda x, y: (not two or sides[x] != sides[y]) and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
    got = near.linking_pairs(arrays, 80, 100, sides)
    assert all(linked(x, y) for x, y in got)

    def parts(edges):
        label = list(range(len(sets)))
        for x, y in edges:
            old, new = label[x], label[y]
            label = [new if v == old else v for v in label]
        return [label.index(v) for v in label]

    every = [(x, y) for x in range(len(sets)) for y in range(x) if linked(x, y)]
    assert parts(got) == parts(every) and len(got) == len(sets) - len(set(parts(every)))


def test_connected_sets():
    near_to = np.zeros((7, 7), bool)
    for x, y in ((0, 3), (3, 5), (1, 6)):
        near_to[x, y] = near_to[y, x] = True
    assert [s.tolist() for s in near.connected(near_to)] == [[0, 3, 5], [1, 6]]


def test_copies_make_few_rows(spark):
    """A thousand near copies of one text are handed on once each, not in pairs."""
    docs = spark.createDataFrame(list(enumerate(loose(9, [1, 2, 3], n=1000, words=80))), "doc_id long, text string")
    run, schema = near._describe(2)
    classes = docs.mapInArrow(run, schema).withColumnRenamed("doc_id", "cls")
    candidates = near._candidates(classes.cache())
    assert candidates.count() < 20_000
    assert set(result(near_duplicates(docs, 2)).values()) == {0}
