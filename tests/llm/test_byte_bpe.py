"""op5's encoder: what it keeps, and its table of pairs."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from quillstone.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_a_word_of_every_text_is_merged_once_however_many_others_there_are(ranks):
    encoder, plain, merged = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, keep=100), byte_bpe.Merger(ranks), []
    merge = encoder.merger.merge
    encoder.merger.merge = lambda pieces: merged.extend(pieces) or merge(pieces)
    r = random.Random(2)
    for _ in range(30):
        text = " ".join(["Start", "zqxvfrequent", *("".join(r.choices("bcdfgqxz", k=9)) for _ in range(60))])
        assert b"".join(encoder.encode([text])) == b"".join(plain.merge([p.encode() for p in encoder.find(text)]))
    assert merged.count(b" zqxvfrequent") == 1
    assert max(len(x) for c in (encoder.words, encoder.parts) for x in (c.young, c.old)) < 400


def test_every_pair_and_no_other_has_its_rank(ranks):
    merger, r = byte_bpe.Merger(ranks), random.Random(3)
    assert merger.keys.size > 1000  # pairs whose place was taken
    pairs = [*merger.pairs, *((r.randrange(-1, 50_000), r.randrange(-1, 50_000)) for _ in range(200_000))]
    left, right = np.array(pairs, np.int64).T
    assert merger._rank(left.copy(), right.copy()).tolist() == [merger.pairs.get(p, -1) for p in pairs]


def test_short_pieces_equal_the_long_form(ranks):
    merger, r = byte_bpe.Merger(ranks), random.Random(5)
    pieces = [bytes(r.choice(b"aehilnorst \xc3\xa4") for _ in range(r.randrange(1, 65))) for _ in range(3000)]
    assert merger.merge(pieces) == [np.array([ranks[p]] if p in ranks else merger._long(p), "<u4").tobytes() for p in pieces]
