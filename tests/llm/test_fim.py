"""Fill-in-middle against a plain version: offsets, slices, forms and the text rebuilt from the output."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import fim, queries

PATTERN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "a", "b", "\x00", "\x1c", "\x85", " ", "　", "é", "日", "\U0001f600", "<", ">", "P", "S", "M", "<P", "P>", "<S><"]


def plain(doc_id, text, seed=42):
    text = text or ""
    tokens = PATTERN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    shown = (len(prefix), len(middle)) if form != "plain" else (None, None)
    return (doc_id, n, form, *shown, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def compare(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    digests = fim.fim_digest(fim.fill_in_middle(frame)).collect()
    assert sorted((tuple(r) for r in digests), key=str) == sorted((plain(i, t) for i, t in rows), key=str)


def test_random_texts(spark):
    g = random.Random(5)
    rows = [(g.choice([None, -i, i, i]), "".join(g.choice(ALPHABET) for _ in range(g.randrange(30)))) for i in range(3000)]
    compare(spark, rows)
    forms = {r["form"] for r in fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_odd_texts(spark):
    long = "wörd  " * 150_000 + "end"
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "<P>", "a<S>b", "<M", long, " " * 400_000, "x" * 400_000, "x" * 300_000 + " " * 300_000 + "y"]
    compare(spark, [(i, t) for i in range(6) for t in texts])


def test_blocks_do_not_move_offsets():
    g = random.Random(6)
    whole, cut = fim.token_ends(), fim.token_ends(block=5)
    for _ in range(2000):
        text = "".join(g.choice(ALPHABET) for _ in range(g.randrange(60)))
        expected = np.array([m.end() for m in PATTERN.finditer(text)], np.int64)
        assert np.array_equal(whole(text), expected) and np.array_equal(cut(text), expected), text


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("n", "form", "output", "_f_text", "a.b c")))
    got = fim.fill_in_middle(rows)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert [r["n"] for r in got.orderBy("doc_id").collect()] == [3, 3, 0]
    assert got.where("doc_id = 1").distinct().count() == 1
    assert fim.fim_digest(fim.fill_in_middle(rows.where("false"))).count() == 0
    other = fim.fill_in_middle(spark.range(200).selectExpr("id AS key", "concat('a b c d ', id) AS body"), seed=7, id_col="key", text_col="body")
    assert other.columns[0] == "key" and other.where(fim.restored(F.col("output"), F.col("form")) != F.concat(F.lit("a b c d "), "key")).count() == 0


def test_query_against_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in queries.op13_fim(spark, sf).collect()) == sorted(plain(r["doc_id"], r["text"]) for r in docs)
