"""The DuckDB statements of the subpackage against its queries, and quality rules certified in several strata."""

from pathlib import Path

import duckdb
import pytest

from millrace.llm import quality, queries
from tests.test_oracles import plain

SF = "/root/testdata/sf0.001"


def same_rows(frame, con, sql):
    columns = sorted(frame.columns)
    cursor = con.execute(sql)
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    expected = sorted(tuple(plain(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect()) == expected


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_statement(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    same_rows(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def strata(spark, tmp_path_factory):
    """Three strata of 240, 230 and 60 good documents; bad ones with symbols, with repeated lines, with both."""
    folder = str(tmp_path_factory.mktemp("strata"))
    prose = lambda i, n=70: " ".join(f"w{i}x{j}" for j in range(n))
    docs, labels = [], []

    def add(lang, text, good):
        docs.append((len(docs), text, lang))
        labels.append((len(docs) - 1, int(good)))

    for i in range(240):
        add("aa", prose(i) + (" # $" if i % 3 == 0 else ""), True)
        if i % 6 == 0:
            add("aa", prose(i) + " ### $$$" * 20, False)
    for i in range(230):
        add(None, prose(i) + ("\nsame\nsame" if i < 12 else ""), True)
        if i % 8 == 0:
            add(None, "\n".join([prose(i), *["again and again"] * 30]), False)
    for i in range(60):
        add("cc", prose(i), True)
        add("cc", prose(i) + " ### $$$" * 20, False)
    docs.append((len(docs), "unlabelled " + prose(7777) + " ### $$$" * 20, "aa"))
    docs.append((len(docs), prose(7778) + " ### $$$" * 20, "zz"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_rules_are_certified_by_stratum(spark, strata):
    report = {r["doc_id"]: r for r in queries.op2_quality(spark, strata).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{strata}/labels.parquet").collect()}
    kept = lambda s, good: {r["kept"] for i, r in report.items() if r["stratum"] == s and labels.get(i) == good}
    assert kept("aa", 1) == {True} and kept("aa", 0) == {False}
    assert kept("", 0) == {False} and kept("", 1) == {True}
    assert kept("cc", 0) == kept("cc", 1) == {True}  # 60 good labels are too few
    last = max(report)
    assert not report[last - 1]["kept"] and report[last]["kept"]
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{strata}/{table}.parquet/*.parquet')")
    same_rows(queries.op2_quality(spark, strata), con, queries.OP2_SQL)


def test_fixed_sequence_stops_at_the_first_failure(spark):
    """Step by step against a plain version with exact tails."""
    from math import comb

    import numpy as np

    g = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(900):
        lang, good = "ab"[i % 2], i % 5 > 0
        symbols = int(g.choice([0, 0, 0, 2, 5, 9, 30])) if not good else int(g.choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 3]))
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(80)) + " #$%" * symbols, lang))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    report = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    cuts = quality.GRID["symbols_per_word"]
    for lang in "ab":
        own = [i for i in report if report[i]["stratum"] == lang]
        step = {i: min([len(cuts) - k for k, c in enumerate(cuts) if report[i]["n_symbols"] / report[i]["n_words"] > c], default=99) for i in own}
        good = [i for i in own if marks[i][1]]
        chosen = 0
        for s in sorted({step[i] for i in own if not marks[i][1]} - {99}):
            k = sum(step[i] <= s for i in good)
            if sum(comb(len(good), j) * quality.ALPHA**j * (1 - quality.ALPHA) ** (len(good) - j) for j in range(k + 1)) > quality.DELTA / 2:
                break
            chosen = s
        assert {i for i in own if not report[i]["kept"]} == {i for i in own if step[i] <= chosen}
