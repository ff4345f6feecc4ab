import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.tables import collected, corpus, docs
from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_as_the_library(encoder, library):
    r = random.Random(1)
    letters = "ab  \n\n\t'sdtre,.1²é世\x1c\xa0👍"
    decoder = bpe.Decoder(bpe.Vocabulary(PATH))
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        if r.random() < 0.2:
            text = text.replace(",", "<|endoftext|>")
        packed = encoder.encode(text)
        assert ids(packed) == library.encode(text, add_special_tokens=False).ids
        assert decoder.decode([packed])[0].decode() == text


def test_every_token_is_reached(encoder):
    texts = bpe.Vocabulary(PATH).texts
    assert all(encoder.piece(t) == [i] for i, t in enumerate(texts))


def test_code_points_in_context(encoder, library):
    for start in range(0, 0x30000, 256):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)} b" for c in range(start, start + 256) if not 0xD800 <= c < 0xE000)
        assert ids(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_very_long_piece(encoder, library):
    for text in ("a" * 20_000, "ab" * 5_000, "x" + " " * 3_000 + "y", "é" * 3_000):
        assert ids(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    small = bpe.Encoder(bpe.Vocabulary(PATH))
    text = " ".join(f"w{i} v{i % 7}" for i in range(2000))
    assert ids(small.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(small) <= 50 and len(small.older) <= 50


def test_table_and_round_trip(spark, library):
    rows = corpus()
    table = docs(spark, rows)
    got = collected(bpe.digests(table, PATH))
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text in rows:
        text = text or ""
        expected = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        row = (len(expected), hashlib.sha256(expected.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert row in {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[doc_id]}
    back = collected(bpe.decode(bpe.encode(table, PATH), PATH))
    assert sorted(r.text for own in back.values() for r in own) == sorted(t or "" for _, t in rows)


def test_broken_ids_become_replacement_characters():
    vocabulary = bpe.Vocabulary(PATH)
    half = vocabulary.ids[0xE4 :0xE5].astype("<u4").tobytes()
    assert bpe.Decoder(vocabulary).decode([half, b""]) == ["�".encode(), b""]


def test_empty_table(spark):
    assert bpe.digests(docs(spark, []), PATH).count() == 0
