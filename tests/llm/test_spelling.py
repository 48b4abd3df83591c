"""Spelling variants against all pairs of a small vocabulary, and against SQL."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import difference, duck
from trainlake.llm import spelling
from trainlake.llm.queries import QUERIES, SQL


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """(word, form, root, n, n_near, form_n) rows from all pairs."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted((w, forms.get(w), root(w), n, len(near[w]), counts.get(forms.get(w))) for w, n in counts.items())


def counted(docs, least=7, every=31):
    import re

    tally = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                tally[run] += 1
    return {w: n for w, n in tally.items() if n >= 2}


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=0, max_size=5), max_size=25))
def test_composition_equals_all_pairs(rests):
    # Lists of one length and of one character more, as the partitions hold them.
    m = min(map(len, rests), default=0)
    members = sorted(r for r in rests if len(r) in (m, m + 1))
    for end in (False, True):
        got = {w: (n, best) for w, n, _, best in spelling.near_in_list(members, [len(r) > m for r in members], members, [1] * len(members), end)}
        want = {}
        for a in members:
            others = [b for b in members if one_edit(a, b) and min(len(a), len(b)) == m]
            if end:
                others = [b for b in others if len(a) == len(b) or not max(a, b, key=len).startswith(min(a, b, key=len))]
            if others:
                want[a] = (len(others), min(others))
        assert got == want


def test_minimised():
    states = spelling.States()
    first = states.acceptor(["tap", "taps", "top", "tops"])
    # t, a|o, p, s: one state each, and the end.
    assert len(states.final) == 5 and states.size[first] == 4
    assert states.acceptor(["ap", "aps", "op", "ops"]) == states.next[first]["t"][0]


@pytest.mark.parametrize("longest", [4_000, 3])
def test_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(spelling, "LIST_WORDS", longest)
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(250)}
    counts = {w: rng.choice((2, 3, 25, 40, 400, 5000)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(table).collect()}
    want = {}
    for w in counts:
        others = [v for v in counts if one_edit(w, v)]
        if others:
            want[w] = (len(others), min(others, key=lambda v: (-counts[v], v)))
    assert near == want


def odd_docs():
    texts = [None, "", "Lanternes lanternes lanternes", "lanterne Lanterne", "ÉTÉSÉTÉS étésétés", "a×bcdefgh " * 3, "x" * 20_000 + " " + "x" * 20_000, "same same", "12345678"]
    texts += ["colourful " * 30 + "colourfl colourfl colorful colorful"] * 3 + [("lantern" + c + " ") * 2 for c in "abcxyz"]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "nullidword nullidword nullidwort"), (3, "lanterne lanterne"), (3, "lanterne lanterne")]


@pytest.mark.parametrize("longest", [4_000, 2])
def test_odd_rows(spark, monkeypatch, longest):
    monkeypatch.setattr(spelling, "LIST_WORDS", longest)
    docs = odd_docs()
    df = spark.createDataFrame([(*d, "w", 4, "k") for d in docs], "doc_id long, text string, word string, n int, key string")
    for every in (3, 10**9):
        got = rows_of(spelling.spelling_variants(df, every=every))
        assert got == brute(counted(docs, every=every))
    assert any(form for _, form, *_ in got)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_chains_of_forms(spark):
    # Each word ten times as frequent as the one before and one character longer.
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    docs = [(k, (w + " ") * (2 * 10**k)) for k, w in enumerate(words)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), every=10**9))
    assert [r[2] for r in got] == ["abcdefghijk"] * 5 and [r[1] for r in got] == [*words[1:], None]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op11_spelling_variants"](spark, sf), SQL["op11_spelling_variants"], duck(sf)) is None
