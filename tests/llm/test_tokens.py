"""Token counts against the tokenizer library, text by text."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trainlake.llm import bytebpe, tokens
from trainlake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  \n x", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "don't 'S x's're 're's", " 'llama '\"ve", "\x1c\x85 　x", "中文 测试 한국", "\U0001f600x\U00020000",
       "͸⿠", "x" * 5000, " " * 3000 + "a", "the cat's 1234 ²½٠ " * 40_000]


@pytest.fixture(scope="module")
def library():
    return bytebpe.load(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.Encoder(PATH, *bytebpe.proof(PATH))


def test_proof(library, encoder):
    # Every vocabulary string but parts of characters and strings that merge otherwise alone.
    assert len(encoder.whole) > 49_000
    assert encoder.rest.search("plain text, été, 中文") is None
    assert encoder.rest.search("\U000e0001") is not None
    assert sum(1 for s in encoder.whole if len(library.encode(s).ids) != 1) == 0


def test_only_byte_level_files():
    with pytest.raises(ValueError):
        bytebpe.load(public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(ValueError):
        bytebpe.load(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stremvld1xé!_　"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_ids_equal_the_library(encoder, library, texts):
    got = [list(memoryview(ids).cast("I")) for ids in encoder.group(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 3)
    monkeypatch.setattr(bytebpe, "GROUP_CHARS", 50)
    monkeypatch.setattr(bytebpe, "HELD", 7)
    small = bytebpe.Encoder(PATH, *bytebpe.proof(PATH))
    texts = ["unheardofwordling " * 30, "zyxwv qqkj", "short"]
    assert [len(ids) // 4 for ids in small.group(texts)] == [len(library.encode(t).ids) for t in texts]


def test_odd_rows(spark, library):
    rows = [(k, t, 1, "n") for k, t in enumerate(ODD)] + [(None, "a b", 2, "n"), (3, None, 2, "n"), (3, "twice", 3, "n"), (3, "twice", 3, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    collected = tokens.count_tokens(docs, PATH, 10).collect()
    assert len(collected) == len(rows)
    got = sorted(tuple(r) for r in collected if r["doc_id"] is not None)
    n = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for k, t, *_ in rows if k is not None]
    assert got == sorted((k, b, c, c > 10) for k, b, c in n)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = Tokenizer.from_file(PATH)
    plain.no_truncation()
    plain.no_padding()
    counts = {k: len(e) for k, e in zip(docs, plain.encode_batch(list(docs.values()), add_special_tokens=False))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    assert got == {k: (len(t.encode()), counts[k], counts[k] > 512) for k, t in docs.items()}
