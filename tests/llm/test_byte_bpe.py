import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cohortlens.llm import byte_bpe as bb
from tests.llm.cases import awkward, empty

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bb.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bb.ByteBpe.from_file(RANKS, P.PATTERN)


def texts():
    rng = random.Random(5)
    alphabet = "abc ABC  \n\t'sd.,!0189éßñ漢字🙂  ́‍<|endoftext|>"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*made, "", " ", "don't we'll I'M", "<|endoftext|>", "a" * 5000, "\x00\x1c\x85", "  leading and trailing  "]


def test_ids_are_those_of_the_reference_and_decode(codec, reference):
    all_texts = texts()
    for text, ids in zip(all_texts, codec.encode(all_texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()


def test_a_full_memory_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bb, "CACHE_PIECES", 5)
    small = bb.ByteBpe.from_file(RANKS, P.PATTERN)
    for _ in range(2):
        assert [i.tolist() for i in small.encode(texts())] == [reference.encode_ordinary(t) for t in texts()]


def test_offsets_cover_split_characters(codec):
    for text in texts():
        ids = next(codec.encode([text]))
        spans = codec.char_spans(ids).T.tolist()
        assert all(0 <= a <= b <= len(text) for a, b in spans)
        assert {k for a, b in spans for k in range(a, b)} == set(range(len(text)))
        for i, (a, b) in zip(ids, spans, strict=True):
            assert codec.bytes[i] in text[a:b].encode()


def brute_spans(reference, text):
    """Code points whose bytes an id holds, byte by byte."""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for i in reference.encode_ordinary(text):
        n = len(reference.decode_single_token_bytes(i))
        out.append((owner[at], owner[at + n - 1] + 1))
        at += n
    return out


def test_offsets_match_brute_force(codec, reference):
    for text in texts():
        assert list(map(tuple, codec.char_spans(next(codec.encode([text]))).T.tolist())) == brute_spans(reference, text)


def test_long_texts_are_split_a_part_at_a_time(monkeypatch, reference):
    monkeypatch.setattr(bb, "CHUNK", 50)
    monkeypatch.setattr(bb, "PIECES", 7)
    small = bb.ByteBpe.from_file(RANKS, P.PATTERN)
    long = [" ".join(texts()), "a" * 300, *texts()[:50]]
    assert [i.tolist() for i in small.encode(long)] == [reference.encode_ordinary(t) for t in long]


def test_documents(spark, reference):
    docs = awkward(spark)
    got = bb.encode_documents(docs.withColumnRenamed("n_chars", "n_tokens"), RANKS, P.PATTERN)
    assert got.count() == docs.count() and set(got.columns) == {"doc_id", "lang", "source", "ids", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    digests = {r.doc_id: r.offsets_crc32 for r in bb.encode_documents(docs, RANKS, P.PATTERN, ids=False).collect()}
    for r in got.collect():
        assert (r.starts, r.ends) == tuple(map(list, zip(*brute_spans(reference, text[r.doc_id]), strict=True))) if r.ids else r.starts == r.ends == []
        assert r.offsets_crc32 == zlib.crc32(np.array(r.starts + r.ends, np.int32).tobytes()) and (r.doc_id == 8 or digests[r.doc_id] == r.offsets_crc32)
        ids = reference.encode_ordinary(text[r.doc_id])
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bb.encode_documents(empty(spark), RANKS, P.PATTERN).count() == 0
