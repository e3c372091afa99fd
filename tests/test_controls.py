"""Failure policies, running sums of hot groups, sources of a configuration, literal patterns in blocks, chunk candidates."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import glossary, memory, relational, reports, rewrite, search
from millrace.sources import files


def test_failure_policies(spark):
    rows = spark.createDataFrame([(1, ["a"], ["h"]), (2, None, ["h1", "h2"]), (3, [], ["h"])], "query_id long, made array<string>, heuristic array<string>")
    under = lambda p: {r["query_id"]: (r["candidates"], r["origin"]) for r in rewrite.with_failure_policy(rows, p).collect()}
    assert under("heuristic-fallback") == {1: (["a"], "model"), 2: (["h1", "h2"], "heuristic"), 3: ([], "model")}
    assert under("skip_to_raw")[2] == ([], "raw")
    for policy in ("fail_run", "no such policy"):
        with pytest.raises(Exception, match="no rewrite candidates for query 2"):
            under(policy)
    assert rewrite.with_failure_policy(rows.where("query_id <> 2")).count() == 2


def test_running_sums_of_a_group_in_many_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), ((F.col("id") * 37) % 3000).alias("k"), (F.col("id") % 5).alias("v"))
    got = {(r["g"], r["k"]): (r["place"], r["running"]) for r in relational.running(rows, "g", ["k"], "v").collect()}
    expected, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (str(r["g"]), r["k"])):
        n, s = seen.get(r["g"], (0, 0))
        expected[r["g"], r["k"]] = (n, s + r["v"])
        seen[r["g"]] = (n + 1, s + r["v"])
    assert got == expected
    assert relational.running(rows.where("false"), "g", ["k"], "v").count() == 0


def test_sources_of_a_configuration():
    a, b = {"source_id": "a", "enabled": True}, {"source_id": "b", "enabled": "no"}
    assert files.enabled_sources([a, b, None, {}]) == [a] == files.enabled_sources({"sources": [a, b]}) == files.enabled_sources(a)
    assert files.enabled_sources(b) == files.enabled_sources(None) == files.enabled_sources({"sources": []}) == []


def test_resume_points(spark):
    items = spark.createDataFrame([(g, i) for g in "abc" for i in range(6)], "g string, i long")
    done = spark.createDataFrame([(0,), (1,), (1,), (3,)], "i long")
    got = {r["g"]: (r["last_done"], r["skipped"], r["resume_at"]) for r in memory.resume_points(items.where("g = 'a' OR (g = 'b' AND i < 2) OR (g = 'c' AND i > 3)"), done, "g", "i").collect()}
    assert got == {"a": (3, 1, 2), "b": (1, 0, None), "c": (None, 0, 4)}


def test_overlays_keep_nested_values(spark):
    rows = spark.createDataFrame([('{"b": [1, {"x": null}], "a": 1.5}', '{"a": {"k": "v"}, "c": null}'), (None, '{"z": true}'), ('{"z": false}', None), ("{}", "{}")], "x string, y string")
    assert [r[0] for r in rows.select(reports.overlaid_json(F.col("x"), F.col("y"))).collect()] == ['{"a":{"k":"v"},"b":[1,{"x":null}],"c":null}', '{"z":true}', '{"z":false}', "{}"]


def test_patterns_in_blocks_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 11} gamma") for i in range(200)], "doc_id long, text string")
    patterns = spark.createDataFrame([(k, p) for k, p in enumerate([f"alpha{i}" for i in range(7)] + [f"beta{i} g" for i in range(11)] + ["", "none"])], "pattern_id long, pattern string")
    whole = sorted(tuple(r) for r in search.literal_matches(docs, patterns).collect())
    monkeypatch.setattr(search, "PATTERN_CHARS", 20)
    assert sorted(tuple(r) for r in search.literal_matches(docs, patterns).collect()) == whole and len(whole) == 600


def test_terms_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 10, "Use JdbcTemplate with @Bean.\nsee ```sh\n$ mvn -q test\nls\n``` and @bean"), (1, 11, "a jdbctemplate and `JdbcTemplate`"), (2, 12, None)], "document_id long, chunk_id long, content string")
    got = {tuple(r) for r in glossary.chunk_candidates(chunks, concepts=False).collect()}
    assert (1, 10, "cli_command", "mvn -q test") in got and not any(x[3] == "ls" for x in got)
    forms = {(r[1], r[2], r[3].lower()) for r in got}
    assert (10, "annotation", "@bean") in forms and all(c != 12 for c, _, _ in forms)
    assert len({r[3] for r in got if r[2] == "annotation"}) == 1


def test_time_spans_are_rounded_and_do_not_depend_on_the_zone_of_the_session(spark, tmp_path):
    import duckdb

    from millrace.plans import registry

    duck = duckdb.connect()
    rows = "(1, TIMESTAMP '2024-03-09 00:00:00', 'view'), (1, TIMESTAMP '2024-03-12 00:00:00', 'error'), (2, TIMESTAMP '2024-03-10 02:30:00', 'view'), (2, TIMESTAMP '2024-03-10 03:30:00', 'error'), (3, TIMESTAMP '1969-12-31 23:59:59.0005', 'view'), (3, TIMESTAMP '1970-01-01 00:00:00.4996', 'error'), (4, NULL, 'view'), (4, NULL, 'error')"
    duck.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) t(user_id, ts, event_type)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    expected = sorted(duck.execute(registry.oracle_sql()["eta_ladder"]).fetchall())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert sorted(tuple(r) for r in registry.queries()["eta_ladder"](spark, str(tmp_path)).collect()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
