"""Words that go straight to the merges get the ids that the whole tokenizer gives them."""

import itertools

import pytest

from panelwright.llm import queries, tokens


@pytest.fixture(scope="module")
def encoder():
    with open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        return tokens._Encoder(f.read(), True)


def test_plain_words_as_the_tokenizer_has_them(encoder):
    assert encoder.plain
    added = ["<|endoftext|>", *(t.content for t in encoder.tokenizer.get_added_tokens_decoder().values())]
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180), 0x301, 0x130, 0x212A, 0x3A3, 0x4E2D, 0x1F600]]
    words = signs + [a + b for a, b in itertools.product(signs, repeat=2)] + [
        "Hello,", "ANESEA!!", "thering***", "a1b22c", "it's", "x'S", "Veröge.", "STRASSEß", "été", "don’t", *added,
        *(f"ab{t}c" for t in added), *(t.upper() for t in added)]
    want = encoder.encode(words)
    got = [encoder.of_plain(w) for w in words]
    assert [(w, g, x) for w, g, x in zip(words, got, want) if g is not None and g != x] == []
    flat, size = encoder.learn([w.encode() for w in words])
    assert size.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_most_words_are_plain(encoder):
    seen = []
    whole, encoder.encode = encoder.encode, lambda texts: seen.extend(texts) or whole(texts)
    try:
        encoder.learn([w.encode() for w in ("onwhon,", "enstgete.", "Veröge.", "ueadoción", "it's", "日本")])
    finally:
        encoder.encode = whole
    assert seen == ["it's", "日本"]
