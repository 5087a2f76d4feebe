"""Ids of texts with every kind of white space, against the tokenizer on the whole text; what is not done again."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumentrace.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(public_tokenizers.path(packing.RANKS), packing.added_tokens())


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]


def test_white_space_of_every_kind(encoder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(4)
    parts = ["the", "a", "Ünter", "don't", "'s", "12", "...", "<|endoftext|>", "x\x1cy", "日本", "é", "!'re", "_", "🙂"]
    spaces = [" ", " ", " ", "\n", "\n", "", "  ", "\n\n", " \n", "\n ", "   ", "\n\n\n", " \n ", "\t", " \t", "\t ", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\xa0", " \xa0", " ", "　", "​"]
    texts = ["", " ", "\n", "  ", "\n\n", " \n", "\n ", "\n\n\n", "\t", " a", "\na", "a\n", "a ", "a\n\n", "a  ", "  a", "\n\na", "\n a", " \na", "\t\ta", "a\n\n\n\nb"]
    for _ in range(3000):
        kinds = spaces[: draw.choice([5, 13, len(spaces)])]
        texts.append("".join(draw.choice(kinds) + draw.choice(["", *parts]) for _ in range(draw.randint(1, 12))))
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, got in zip(part, ids_of(encoder, part)):
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_changes_no_ids(encoder, monkeypatch):
    texts = [f"word{i} and\nline{i}  twice\n\n\nthrice" for i in range(50)]
    want = ids_of(encoder, texts)
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    assert [x for t in texts for x in ids_of(encoder, [t])] == want
    assert len(encoder.known) < 20


def test_texts_of_lines_need_no_pattern_and_workers_keep_their_encoder(encoder, monkeypatch):
    texts = ["one two\nthree four\n\nfive six\n", "\none two"]
    want = ids_of(encoder, texts)
    monkeypatch.setattr(packing, "_CUT", None)
    assert ids_of(encoder, texts) == want
    key = public_tokenizers.path(packing.RANKS), tuple(packing.added_tokens().items())
    assert packing._encoder(*key) is packing._encoder(*key)
