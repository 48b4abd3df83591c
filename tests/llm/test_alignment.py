"""Cross-tokenizer alignment against a plain count over all documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from trainlake.llm import alignment, bytebpe
from trainlake.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """The result columns after doc_id, text by text, from dictionaries."""
    library = bytebpe.load(A)
    library.encode_special_tokens = True
    spelled = {i: s for s, i in bytebpe.token_bytes(library).items()}
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    linked = []
    for text in texts:
        text = text or ""
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        bytes_a = [spelled[i] for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        groups, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(bytes_a[i])
                left.append(a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                right.append(b[j])
                j += 1
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        linked.append((len(a), len(b), groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    holders = Counter(pair for *_, links in linked for pair in links)
    highest = {}
    for (x, _), n in holders.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for n_a, n_b, groups, links in linked:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for (x, y), n in links.items() if holders[x, y] == highest[x])
        count_sum = sum(n * holders[pair] for pair, n in links.items())
        out.append((n_a, n_b, len(groups), sum(links.values()), n_best, count_sum, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def expected(ids, texts):
    return sorted(((k, *row) for k, row in zip(ids, brute(texts))), key=repr)


ODD = [None, "", " ", "a", "the the the", "ab▁cd", "tab\there\nline", "<s> <unk> <0x41> <|endoftext|>", "été 中文 \U0001f600 ͸", "same text here", "same text here", "z" * 3000, "\x00a", "Antidisestablishment " * 4000]


def test_odd_rows(spark):
    ids = [None, 7, 7, *range(10, 10 + len(ODD) - 3)]
    rows = [(k, t, "x", 3) for k, t in zip(ids, ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string, radix int")
    assert rows_of(alignment.align(docs, A, B)) == expected(ids, ODD)
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert rows_of(alignment.align(docs.filter("text is null"), A, B)) == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_many_small_runs_of_a_hot_pair(spark, monkeypatch):
    # Runs of few documents, merged in several rounds, and one text that a third of all rows hold.
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    rng = random.Random(5)
    words = ["hot", "lantern", "querulous", "café", "zebra's", "1234", "unfathomableness", "\n\n", "ß"]
    texts = ["hot hot hot"] * 200 + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(13)
    assert rows_of(alignment.align(docs, A, B)) == expected(range(600), texts)


def test_buffers_that_fill_up(monkeypatch):
    monkeypatch.setattr(alignment, "RUN_LINKS", 50)
    aligner = alignment.Aligner(A, B, bytebpe.proof(A, plain=True))
    texts = ["some text with unheardofwordlings " * 20, "", "more"]
    found, keys, times = aligner.group(texts, 4)
    assert [tuple(r[:4]) for r in found] == [r[:4] for r in brute(texts)]
    assert times.sum() == sum(r[3] for r in found) and (np.diff(keys.astype(object)) > 0).all()
    assert set((keys & np.uint64((1 << aligner.layout.doc_bits) - 1)).tolist()) == {4, 6}


@pytest.mark.parametrize("rising", [False, True])
def test_frames(rising):
    rng = np.random.default_rng(1)
    for n in (0, 1, 40_000):
        values = rng.integers(0, 2**63, n, dtype=np.uint64)
        values = np.sort(values) if rising else values
        assert (alignment.unpack(alignment.pack(values, rising), np.uint64, rising) == values).all()


def test_heap_merge_and_maxima():
    rng = random.Random(2)
    runs, total = [], Counter()
    for _ in range(9):
        run = sorted(set(rng.choices(range(300_000), k=rng.choice((0, 1, 60_000)))))
        total.update(run)
        runs.append((alignment.pack(np.array(run, np.uint64), True), alignment.pack(np.ones(len(run), np.uint32))))
    got = list(alignment.with_maxima(alignment.merged(runs), 6))
    pairs, counts, best = (np.concatenate(x).tolist() for x in zip(*got))
    assert pairs == sorted(total) and counts == [total[p] for p in pairs]
    highest = {}
    for p, n in total.items():
        highest[p >> 6] = max(highest.get(p >> 6, 0), n)
    assert best == [int(total[p] == highest[p >> 6]) for p in pairs]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert rows_of(QUERIES["op13_token_alignment"](spark, sf)) == expected([r["doc_id"] for r in docs], [r["text"] for r in docs])
