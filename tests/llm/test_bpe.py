"""The encoder against the library: every code point between letters, mixed scripts, few states."""

import random

import pytest

from millrace.llm import bpe, queries


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = queries.word_tokenizer_path()
    return Tokenizer.from_file(path), bpe.WordCodec(bpe.read_spec(path))


def test_every_code_point_between_letters(both):
    reference, codec = both
    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(points), 5000):
        texts = [f"a{chr(c)}b" for c in points[at : at + 5000]]
        found = reference.encode_batch(texts, add_special_tokens=False)
        wrong += [hex(ord(t[1])) for t, e in zip(texts, found, strict=True) if codec.encode(t) != e.ids]
    assert wrong == []


def test_mixed_scripts(both):
    reference, codec = both
    r = random.Random(3)
    ranges = [(32, 127), (160, 0x250), (0x370, 0x600), (0x900, 0xE00), (0x1100, 0x1200), (0x1E00, 0x2100), (0x2E80, 0x3200), (0xAC00, 0xAD00), (0xFB00, 0xFE00), (0x10300, 0x10400), (0x1F600, 0x1F650)]
    for _ in range(3000):
        text = "".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randint(1, 25)))
        assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids, text


def test_runs_of_marks(both):
    """Marks in any order, among them those that Python and the library order differently."""
    reference, codec = both
    for text in ("\u0309\u089a", "\u0350\u0d3c", "\u089c\u05c5", "x\u089c\u0301y"):
        assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids, text
    import unicodedata

    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M"]
    r = random.Random(11)
    texts = ["".join(r.choice("aeé한ก ") + "".join(r.choices(marks, k=r.randint(1, 4))) for _ in range(r.randint(1, 3))) for _ in range(20_000)]
    found = reference.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, found, strict=True) if codec.encode(t) != e.ids] == []


def test_states_are_bounded():
    path = queries.word_tokenizer_path()
    codec = bpe.WordCodec(bpe.read_spec(path), keep=10)
    codec.automaton.keep = 100
    r = random.Random(1)
    words = ["".join(r.choices("abcdehilnorst", k=r.randint(1, 14))) for _ in range(500)]
    whole = bpe.WordCodec(bpe.read_spec(path))
    assert all(codec.encode(w) == whole.encode(w) for w in words) and len(codec.automaton.states) <= 100


def test_transitions_are_taken_from_the_table(both, monkeypatch):
    """A word read before takes no arc and lays no transition."""
    _, codec = both
    symbols = [*b"unbelievabl", ord("e") + 256]
    first = codec.automaton.encode(symbols)
    monkeypatch.setattr(bpe.MergeAutomaton, "arc", None)
    monkeypatch.setattr(bpe.MergeAutomaton, "determinise", None)
    assert codec.automaton.encode(symbols) == first
