"""Profiles, distances and predictions against a plain version; folds of the query."""

import random
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, queries

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    found = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for n, padded in ((1, w), (2, f" {w} "), (3, f" {w} ")):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def pack(gram):
    return sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))


def plain_list(counts, places):
    return [pack(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], pack(x[0])))][:places]


def test_predictions_against_a_plain_version(spark):
    r = random.Random(2)
    words = {"a": ["the", "and", "house", "of", "ing"], "b": ["der", "und", "haus", "schön", "die"], "c": ["le", "maison", "été", "the", "und"]}
    train = [(i, " ".join(r.choices(words["abc"[i % 3]], k=r.randint(1, 30))), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df, places=25)
    lists = {lang: plain_list(sum((plain_counts(t) for _, t, name in train if name == lang), Counter()), 25) for lang in "abc"}
    texts = [(i, " ".join(r.choices(words["abc"[r.randrange(3)]] + words["abc"[r.randrange(3)]], k=r.randint(1, 20)))) for i in range(80)] + [(900, None), (901, "12 !"), (902, "")]

    def plain(text):
        own = plain_list(plain_counts(text or ""), 25)
        if not own:
            return "und", 0.0
        sums = {lang: sum(abs(i - lists[lang].index(k)) if k in lists[lang] else 25 for i, k in enumerate(own)) / (25 * len(own)) for lang in lists}
        best = min(sorted(sums), key=lambda x: sums[x])
        return best, max(0.0, 1 - sums[best])

    found = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), profiles).collect()}
    for i, t in texts:
        lang, score = plain(t)
        assert found[i][0] == lang and found[i][1] == pytest.approx(score), t


def test_no_language_is_left_out(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.translate((F.col("id") % 150).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 150).cast("string")).alias("lang"))
    assert len(langid.learn_profiles(df).languages) == 150


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_folds_of_the_query(spark):
    rows = {r["doc_id"]: r for r in queries.op5_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(rows) == set(truth) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r["held_out"] and truth[i] and r["lang_pred"] != "und"]
    assert len(held) > 100 and sum(rows[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.99
