import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from morpholake.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def encoded(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []


def test_replay_equals_the_library(library):
    encoder, rng = bpe.Encoder(PATH, P.PATTERN), random.Random(3)
    alphabets = ("aaab", "ab  \n\t'stré.!", "etaoin shrdlu", " \u3000\x85\x1c\u00a0x", "漢字🙂éß01９")
    for k in range(1500):
        text = "".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randint(0, 200)))
        assert encoded(encoder, [text])[0] == library.encode_ordinary(text), repr(text)
    for text in ("a" * 5000, "ab" * 3000 + " x", "", "don't  stop\n\n now "):
        assert encoded(encoder, [text])[0] == library.encode_ordinary(text)


def test_parts_need_the_known_pattern(library):
    encoder = bpe.Encoder(PATH, P.PATTERN)
    encoder.gapped = False
    text = "Two  words, one\ttab and 'll."
    assert encoded(encoder, [text])[0] == library.encode_ordinary(text)


def test_slices_and_forgetting_do_not_matter(library, monkeypatch):
    """Texts together, one by one and with a cache that is emptied again and again have the same ids."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2_000)
    encoder, rng = bpe.Encoder(PATH, P.PATTERN), random.Random(5)
    alphabet = [" ", "  ", "\n", " \n", "foo", "bar\n", "é", "don't", "x" * 500, "\u2003", "12", ",", ""]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = [library.encode_ordinary(x) for x in texts]
    assert encoded(encoder, texts) == want
    assert [encoded(encoder, [x])[0] for x in texts] == want
    assert encoded(encoder, texts[:200]) + encoded(encoder, []) + encoded(encoder, texts[200:]) == want


def test_query(spark, sf, library):
    from morpholake.llm.queries import op2_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_round_trip(odd, empty):
    encoded = bpe.encode_documents(odd.drop("ids"), PATH, P.PATTERN, ["doc_id", "at"])
    assert encoded.count() == odd.count()
    back = bpe.decode_documents(encoded, PATH, ["doc_id"]).collect()
    assert sorted((r.text for r in back)) == sorted((r.text or "") for r in odd.collect())
    assert bpe.encode_documents(empty, PATH, P.PATTERN, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(odd, PATH, P.PATTERN, ["ids"])
