import hashlib
import random

import public_tokenizers
import pytest
import regex

from nocturne.llm import tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_digests_agree_with_the_library(hard):
    coder = tokens.encoding(PATH, PATTERN)
    want = []
    for r in hard.select("doc_id", "text").collect():
        ids = coder.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.token_digests(hard, PATH, PATTERN).collect()]
    assert sorted(got) == sorted(want)


def test_ids_and_bytes_as_columns(hard):
    out = tokens.decoded(tokens.tokenized(hard, PATH, PATTERN), PATH, PATTERN)
    assert out.columns == [*hard.columns, "token_ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.select("text", "decoded").collect())


@pytest.mark.parametrize("seed", range(5))
def test_safe_boundaries_change_nothing(seed):
    r = random.Random(seed)
    text = "".join(r.choices(["a", "B'll", " ", "  ", "\n", "7", "!?", "é", "日", " ", " ", " x", " 's", "\t"], k=4000))
    coder = tokens.encoding(PATH, PATTERN)
    for size in (1, 7, 100):
        parts = list(tokens.parts(text, size))
        assert "".join(parts) == text and [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000 + "x", "\n" * 200_000, "^" * 100_000, "é1" * 60_000])
def test_long_texts_without_a_boundary(text):
    coder = tokens.encoding(PATH, PATTERN)
    ids = tokens.encode(coder, regex.compile(PATTERN), text)
    assert ids == coder.encode_ordinary(text)


def test_a_text_the_library_cannot_split_at_once():
    coder = tokens.encoding(PATH, PATTERN)
    text = "\n" * 3_000_000
    assert coder.decode_bytes(tokens.encode(coder, regex.compile(PATTERN), text)) == text.encode()


def test_empty_table(none):
    assert tokens.token_digests(none, PATH, PATTERN).count() == 0
