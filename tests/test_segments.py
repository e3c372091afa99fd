"""Segments: known answers, and texts given back by joining them."""

import random
import re

from millrace.operators.segments import segments


def cut(text, most=4000):
    return [(kind, text[s:e]) for kind, s, e in segments(text, most)]


def test_blocks():
    text = "# Title\nOne line\nand more\n\n- item\n1) two\n| a | b |\n| - | - |\n```py\nx = 1\n\n# no heading\n```\nend\n~~~\nopen"
    assert cut(text) == [
        ("text", "# Title\n"), ("text", "One line\nand more\n"), ("blank", "\n"), ("text", "- item\n"), ("text", "1) two\n"), ("text", "| a | b |\n"), ("text", "| - | - |\n"),
        ("code", "```py\nx = 1\n\n# no heading\n```\n"), ("text", "end\n"), ("code", "~~~\nopen")]
    assert cut(None) == [] and cut("") == [] and cut("    # code like\n#no") == [("text", "    # code like\n#no")]


def test_long_prose_is_cut_between_sentences():
    assert cut("One two. Three four! Five six? Seven", 20) == [("text", "One two. "), ("text", "Three four! "), ("text", "Five six? Seven")]
    assert cut("One two. Three four! Five six? Seven", 21) == [("text", "One two. Three four! "), ("text", "Five six? Seven")]
    assert cut("x" * 50 + ". ab. cd.", 10) == [("text", "x" * 50 + ". "), ("text", "ab. cd.")]
    assert cut("日本語。 次の文。 終", 8) == [("text", "日本語。 "), ("text", "次の文。 終")]


def test_joined_segments_are_the_text():
    r = random.Random(4)
    parts = ["a. ", "b\n", "\n", "```\n", "~~~", "# h\n", "- i\n", "| t\n", "word ", "! ", "\r\n", " ", "  "]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        most = r.choice([3, 10, 4000])
        assert "".join(x for _, x in cut(text, most)) == text
        for kind, x in cut(text, most):
            assert kind != "text" or len(x) <= most or not re.search(r"(?<=[.!?])\s+(?=\S)", x)
