"""Fingerprints and the Gray-order index against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard, simhash
from millrace.llm.common import components


def plain_fingerprint(text, width=3):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_a_plain_version(spark):
    r = random.Random(6)
    parts = ["The", "ÄPFEL", "a", "İx", "ﬁ", "x y", "日本", "\x1c", "B-b", "Σ"]
    texts = [None, "", " \n\t\x0b", "One", "One two", "a a a a a a"] + ["".join(r.choice(parts) + r.choice([" ", "\n", "  ", "\r\n"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["fingerprint"] for x in simhash.near_duplicates(df).collect()}
    assert found == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert simhash.shingle_fingerprint(b" ".join(b"w%d" % i for i in range(500)), block=16) == plain_fingerprint(" ".join(f"w{i}" for i in range(500)))


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 2), (1, 9), (2, 2), (2, 30)])
def test_gray_index_finds_all_pairs(words, radius):
    g = np.random.default_rng(radius)
    codes = g.integers(0, 1 << 63, (60, words), dtype=np.uint64)
    near = codes[g.integers(0, 60, 140)].copy()
    for i in range(len(near)):
        for bit in g.integers(0, 64 * words, g.integers(0, radius + 3)):
            near[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    codes = np.unique(np.concatenate([codes, near]), axis=0)
    expected = {(i, j) for i in range(len(codes)) for j in range(i) if sum(int(a ^ b).bit_count() for a, b in zip(codes[i], codes[j], strict=True)) <= radius}
    found = [(max(x, y), min(x, y)) for lot in simhash.GrayIndex(codes).links(radius) for x, y in zip(*map(np.ndarray.tolist, lot), strict=True)]
    assert set(found) == expected and len(found) == len(expected)
    root = np.arange(len(codes)) // 2
    assert {(max(x, y), min(x, y)) for lot in simhash.GrayIndex(codes).links(radius, root) for x, y in zip(*map(np.ndarray.tolist, lot), strict=True)} == {(i, j) for i, j in expected if root[i] != root[j]}


def test_gray_rank_orders_as_the_gray_sequence():
    codes = np.array([i ^ i >> 1 for i in range(256)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(256))
    wide = np.stack([codes >> np.uint64(4), codes << np.uint64(60)], axis=1)  # the same sequence over two words
    rank = simhash.gray_rank(wide)
    assert np.lexsort(rank.T[::-1]).tolist() == list(range(256))


def test_hot_upper_nodes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    g = np.random.default_rng(8)
    center = int(g.integers(0, 1 << 63))
    codes = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in g.integers(0, 64, (400, 3))})
    df = spark.createDataFrame([(simhash.signed(c), i) for i, c in enumerate(codes)], "fp long, node long")
    assert simhash._dealt(df.selectExpr("fp", "node", "0 AS mask", "0L AS pattern")).where("low <> high").count() > 0
    found = {r["node"]: r["component"] for r in components(simhash.search(df)).collect()}
    component, changed = list(range(len(codes))), True
    while changed:
        changed = False
        for i in range(len(codes)):
            for j in range(i):
                if component[i] != component[j] and (codes[i] ^ codes[j]).bit_count() <= 2:
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
    assert [found.get(i, i) for i in range(len(codes))] == component


def test_wide_fingerprints_of_similar_sets():
    """At a Jaccard similarity of 0.8 the radius holds with room; unlike sets stay far outside."""
    g = np.random.default_rng(5)
    apart, far = [], []
    for _ in range(400):
        union = g.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2) + g.integers(0, 2, 100, dtype=np.uint64)
        x, y = jaccard.fingerprint(union[:90]), jaccard.fingerprint(union[10:])
        apart.append(np.bitwise_count(x ^ y).sum())
        far.append(np.bitwise_count(x ^ jaccard.fingerprint(g.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum())
    assert np.mean(apart) + 5.3 * np.std(apart) < jaccard.RADIUS < np.mean(far) - 3 * np.std(far)


@pytest.mark.parametrize("least", [None, 0.8])
def test_rows_are_kept_by_component_id_and_text(spark, least):
    """Unlike texts under one id stay; copies go whatever their ids; the row of the least id stays, not one that shares its id."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    a, b, c, d, e = (text(k) for k in "abcde")
    rows = [(5, a, 1), (5, b, 2), (7, c, 3), (9, b, 4), (3, d, 5), (3, d, 6), (None, e, 7), (None, e, 8), (None, a, 9), (None, text("f"), 10), (8, text("g"), 11), (8, text("g") + " ", 12), (6, c, 13), (6, text("h"), 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = simhash.one_of_each(docs, width=5, least=least).collect()
    expected = [(5, a), (5, b), (6, c), (3, d), (None, e), (None, text("f")), (8, text("g")), (6, text("h"))]
    assert sorted(((r["doc_id"], r["text"].strip()) for r in kept), key=str) == sorted(expected, key=str)
    again = simhash.one_of_each(docs.repartition(5), width=5, least=least).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept))


def test_one_id_for_all_rows_loses_none(spark):
    docs = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.col("id") % 100, F.lit(f"x{j}")) for j in range(12))).alias("text"))
    assert simhash.one_of_each(docs, width=5, least=0.8).select("text").distinct().count() == 100 == simhash.one_of_each(docs, width=5, least=0.8).count()
