"""Sharding, mixing and packing: laws of the results and exact counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import difference, duck
from trainlake.llm import bytebpe, mixing, packing, sharding
from trainlake.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, source string, copies string, rank int, arc string"


def odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x", None), (3, "x", None), (None, "y", "b"), (None, None, "b"), (4, "word " * 30_000, "a")]
    rows += [(k, "same text", "hot") for k in range(10, 60)]
    return spark.createDataFrame([(*r, "c", 5, "q") for r in rows], SCHEMA)


def test_shards_are_even_and_gapless(spark):
    got = sharding.shard_rows(odd_rows(spark), 5).collect()
    assert len(got) == 57
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 1} == {(8, 0)}
    assert sharding.shard_rows(odd_rows(spark).limit(0), 5).count() == 0


def test_place_arcs_continue_clockwise():
    # Arc 0 overflows its shard 0; the rest goes on to shard 1, then 2.
    assert sharding.place_arcs([7, 1, 1], [0, 1, 2], 3) == [(0, 0, 3, 0, 0), (1, 0, 1, 1, 0), (2, 0, 1, 2, 0), (0, 3, 5, 1, 1), (0, 5, 7, 2, 1)]


def test_growing_moves_few_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 24).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 25).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)


def test_shard_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_consistent_sharding"](spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got) and all(r["slot"] < sizes[r["shard"]] for r in got)


def test_mixing_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op4_poisson_mixing"](spark, sf), SQL["op4_poisson_mixing"], duck(sf)) is None


def test_poisson_tables(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 4.0), (None, 900.0), ("z", 0.0)], "source string, rate double")
    got = {r["source"]: r["cdf"] for r in mixing.poisson_tables(rates).collect()}
    assert set(got) == {"a", "b", None}
    for source, rate in (("a", 0.3), ("b", 4.0), (None, 900.0)):
        c = 0.0
        for k, value in enumerate(got[source]):
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert value == pytest.approx(c, abs=1e-9)
        assert got[source][-1] == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("entries", [0, 10**9])
def test_mixing_odd_rows(spark, monkeypatch, entries):
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", entries)
    docs = odd_rows(spark)
    weights = spark.createDataFrame([("a", 1.0), (None, 5.0), ("b", 1.0), ("none", 3.0)], "source string, weight double")
    out = mixing.mix_sources(docs, weights, total=400, seed=3)
    assert out.columns == ["doc_id", "text", "source", "rank", "arc", "copies", "copy"]
    rows = out.collect()
    assert {r["source"] for r in rows} == {"a", "b", None}
    assert 300 < len(rows) < 500 and sum(r["source"] is None for r in rows) > sum(r["source"] == "a" for r in rows)
    seen = Counter((r["doc_id"], r["text"], r["copy"]) for r in rows)
    assert all(n == (2 if k[0] == 3 else 1) for k, n in seen.items())
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0
    assert mixing.mix_sources(docs, weights.limit(0)).count() == 0


def check_packing(docs, got, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r["length"] for r in got) // capacity)


def test_packing_odd_rows(spark):
    docs = odd_rows(spark)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 64).collect()
    used, least = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], got, 64)
    assert used <= least + 1
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_special_strings_and_cache(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = random.Random(2)
    words = ["<|endoftext|>", "don't", "Ünï—x", "a b", "ÀÉ", "12,3.", "é", "it's", "<|startoftext|>ab", "中文字"]
    docs = [(k, " \n".join(rng.choice([*words, str(rng.random())]) for _ in range(rng.randint(0, 90)))) for k in range(40)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 100).collect()
    check_packing(docs, got, 100)


def test_bins_near_the_bound():
    rng = random.Random(5)
    for draw, most in ((lambda: min(4096, int(rng.lognormvariate(6, 1)) + 1), 1.001), (lambda: rng.randint(1, 4096), 1.01)):
        sizes = Counter(draw() for _ in range(20_000))
        fillings = packing.complete_bins(dict(sizes))
        used = Counter()
        for times, need in fillings:
            assert sum(a * k for a, k in need) <= 4096
            for a, k in need:
                used[a] += k * times
        assert used == sizes
        assert sum(t for t, _ in fillings) <= most * -(-sum(a * n for a, n in sizes.items()) // 4096) + 1


def test_packing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packing(docs, QUERIES["op5_best_fit_packing"](spark, sf).collect(), 4096)
    assert used <= least + 1


def fewest(sizes, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        tried = set()
        for i, used in enumerate(bins):
            if used + sizes[k] <= capacity and used not in tried:
                tried.add(used)
                bins[i] += sizes[k]
                place(k + 1, bins)
                bins[i] -= sizes[k]
        place(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def sequences(fillings):
    return [[a for a, k in need for _ in range(k)] for times, need in fillings for _ in range(times)]


def test_branching_needs_the_fewest_sequences():
    rng = random.Random(11)
    for _ in range(1500):
        sizes = [rng.randint(15, 60) for _ in range(rng.randint(8, 12))]
        found = sequences(packing.complete_bins(dict(Counter(sizes)), 100))
        assert sorted(a for s in found for a in s) == sorted(sizes) and all(sum(s) <= 100 for s in found)
        assert len(found) == fewest(sizes, 100), sizes
    assert len(sequences(packing.complete_bins(dict(Counter([19, 25, 27, 27, 29, 39, 40, 42, 44, 47, 48])), 100))) == 4


def test_branching_ends_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(packing, "BRANCHES", 30)
    rng = random.Random(2)
    histogram = Counter(rng.randint(1, 200) for _ in range(3000))
    found = sequences(packing.complete_bins(dict(histogram), 256))
    assert Counter(a for s in found for a in s) == histogram and all(sum(s) <= 256 for s in found)
    assert len(found) <= 1.03 * sum(a * n for a, n in histogram.items()) / 256


def test_words_merge_by_rank_as_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = packing._Encoder(path, bytebpe.word_end_ranks(path))
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCéüß'!?.,-0123456789"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(5000)] + ["don't", "a\x00b", "\x00", "\U0001f600", "<|endoftext|>"]
    for word in words:
        assert list(memoryview(encoder.encode(word)).cast("I")) == library.encode(word, add_special_tokens=False).ids, word
    with pytest.raises(ValueError):
        bytebpe.word_end_ranks(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_of_many_texts_are_merged_by_one_call(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, proved = Tokenizer.from_file(path), bytebpe.word_end_ranks(path)
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéüß'!?.,-0123456789"
    plain = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(3000)]
    odd = ["don't", "a\x00b", "\x1c", "x y", "\x0b", "ª²", "\U0001f600", "İ", "中文字", ""]
    texts = [None, "", "  \n", *[" \t".join(rng.choices(plain, k=rng.randint(0, 60))) + rng.choice(["", "\r\n"]) for _ in range(200)]]
    encoder, calls = packing._Encoder(path, proved), []
    one, every = encoder.words.make, encoder.merge_all
    encoder.words.make = lambda word: calls.append(word) or one(word)
    encoder.merge_all = lambda text, special: calls.append(text) or every(text, special)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(ids).cast("I")) for ids in encoder.encode_all(texts)] == want
    assert len(calls) == 1  # not one for every word
    # Texts that hold special strings, rare characters or very many words, among the others; words forgotten between.
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "GROUP_CHARS", 300)
    texts += [" ".join(rng.choices([*plain, *odd, "<|endoftext|>"], k=rng.randint(0, 90))) for _ in range(200)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = packing._Encoder(path, proved)
    assert [list(memoryview(ids).cast("I")) for ids in encoder.encode_all(texts)] == want
    # Without the proof the library merges, text by text.
    assert [list(memoryview(ids).cast("I")) for ids in packing._Encoder(path).encode_all(texts[:40])] == want[:40]
