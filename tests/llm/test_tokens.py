"""Token operators against the libraries themselves."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkmix.llm.bpe_files import JsonTokenizer, json_tokenizer, read_ranks
from sparkmix.llm.byte_bpe import BytePairCoder, coder, decode_ids, encode_texts, round_trip
from sparkmix.llm.token_counts import count_tokens, splice

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "a" * 3000, "don't  stop\n\n now", "日本語 текст é🙂", "<|endoftext|>x<|endoftext|>", "12 345\t\t!", "  x"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD + ODD[:3])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_every_code_point_as_the_library():
    fast, slow = json_tokenizer(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    for lo in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}\n" for c in range(lo, lo + 4096, 7) if not 0xD800 <= c < 0xE000)
        assert fast.encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_counts(spark, frame):
    slow = Tokenizer.from_file(JSON)
    got = {r.doc_id: r for r in count_tokens(frame, JSON, P.PATTERN).collect()}
    assert len(got) == frame.count()
    for i, t in enumerate(ODD):
        n = len(slow.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert count_tokens(frame.limit(0), JSON, P.PATTERN).count() == 0


def test_splice_equals_whole():
    tok, rnd = json_tokenizer(JSON, P.PATTERN), random.Random(5)
    parts = ["a", "the", " ", "\n", "é", "日本", "<|endoftext|>", "  ", "foo ", "123", "'s"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 200)))
        assert [i for p in splice(text, tok, 30, 2) for i in p] == tok.encode(text)


def test_splice_without_any_boundary():
    tok = json_tokenizer(JSON, P.PATTERN)
    text = "x" * 5000  # no white space: the overlap widens to the end
    assert [i for p in splice(text, tok, 100, 4) for i in p] == tok.encode(text)


def test_other_files_use_the_library():
    path = P.path("word_bpe_49k.json")
    assert JsonTokenizer(path, P.PATTERN).encode("Hello there") == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def test_byte_bpe_equals_tiktoken(spark, frame):
    want = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    code, rnd = coder(RANKS, P.PATTERN), random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice("abeinost  \n'é日本🙂àßthe12#") for _ in range(rnd.randint(1, 40)))
        assert code.encode(text) == want.encode_ordinary(text)
    got = {r.doc_id: r for r in round_trip(frame, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = want.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(spark, frame):
    back = decode_ids(encode_texts(frame, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(ODD + ODD[:3])}


def test_memo_generations():
    small = BytePairCoder(read_ranks(RANKS), P.PATTERN)
    small.MEMO = 5
    text = "the quick brown fox jumps over the lazy dog and the quick red fox again"
    assert [small.encode(text) for _ in range(4)] == [coder(RANKS, P.PATTERN).encode(text)] * 4
