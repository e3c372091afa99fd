"""Relations built twice, canonical expansion, targets, crawls against a sequential one, audits."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, crawl, dataset, expansion, relations
from millrace.plans import graph_queries as G
from millrace.plans import registry

SF = "/root/testdata/sf0.001"


def edges(spark, rows):
    return spark.createDataFrame(rows, "seed long, related long, score double, evidence long, method string")


def test_builds_close_what_they_do_not_find(spark):
    one = [relations.Source("alias", "map", edges(spark, [(1, 2, 0.9, 1, None), (1, 3, 0.5, 1, None), (2, 1, 0.9, 1, None)])), relations.Source("query", "link", edges(spark, [(1, 2, 0.7, 4, "A"), (1, 4, 0.7, 9, "B"), (1, 5, 0.6, 9, "B")]))]
    first = relations.build(None, one, "v", "r1", 0.55, 2)
    assert sorted((r["seed"], r["related"], r["kind"]) for r in first.collect()) == [(1, 2, "alias"), (1, 2, "query"), (1, 4, "query"), (2, 1, "alias")]
    again = relations.build(first, one, "v", "r2", 0.55, 2)
    strip = lambda df: sorted(map(str, df.drop("run").collect()))
    assert strip(again) == strip(first) and {r["run"] for r in again.collect()} == {"r2"}
    other = relations.build(again, one, "w", "r3", 0.55, 2)
    later = relations.build(other, [relations.Source("query", "link", edges(spark, [(1, 5, 0.8, 1, "C")]))], "v", "r4", 0.55, 2)
    state = {(r["version"], r["seed"], r["related"], r["kind"]): (r["status"], r["run"]) for r in later.collect()}
    assert state["v", 1, 5, "query"] == ("active", "r4") and state["v", 1, 2, "query"] == ("superseded", "r2") and state["v", 1, 4, "query"] == ("superseded", "r2")
    assert state["v", 1, 2, "alias"] == ("active", "r2") and state["w", 1, 4, "query"] == ("active", "r3")
    back = relations.build(later, one, "v", "r5", 0.55, 2)
    state = {(r["version"], r["seed"], r["related"], r["kind"]): (r["status"], r["run"]) for r in back.collect()}
    assert state["v", 1, 4, "query"] == ("active", "r5") and state["v", 1, 5, "query"] == ("superseded", "r4") and len(state) == back.count()


def test_edges_of_each_source(spark):
    terms = spark.createDataFrame([(1, "A", "class", True), (2, "B", "concept", True), (3, "C", "concept", True), (4, "D", "class", False), (5, "E", "class", True)], "term_id long, form string, term_type string, active boolean")
    maps = spark.createDataFrame([(1, 1, 2, 0.4), (2, 1, 2, None), (3, 2, 1, 0.3), (4, 1, 4, 1.0), (5, 1, None, 1.0), (6, 1, 1, 1.0)], "mapping_id long, term long, alias_term long, confidence double")
    assert sorted((r["seed"], r["related"], r["score"], r["evidence"]) for r in relations.alias_edges(maps, terms).collect()) == [(1, 2, 1.0, 2), (2, 1, 1.0, 2)]
    links = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "A"), (2, 1, "B"), (2, 2, "B"), (3, 4, "C"), (3, 1, "C"), (4, 5, None), (4, 1, None), (4, 1, None)], "unit long, term long, method string")
    got = {(r["seed"], r["related"]): (r["evidence"], r["method"]) for r in relations.shared_edges(links, terms, "unit", relations.BY_QUERY).collect()}
    assert got == {(1, 2): (2, "mixed"), (2, 1): (2, "mixed"), (1, 3): (1, "A"), (3, 1): (1, "A"), (1, 5): (1, None), (5, 1): (1, None)}


def test_expansion_finds_longest_and_compact_forms(spark):
    anchors = spark.createDataFrame([("g1", 0, True, "spring boot", "Spring-Boot", "springboot"), ("g2", 1, True, "JNDI", " ", None), ("g2", 2, True, "naming service", "jndi", "이름 서비스"), ("g3", 3, False, "unused", "unused", "unused"), ("g4", 4, True, "@Bean", "bean factory", "x")], "group string, at int, used boolean, a string, b string, c string")
    variants = expansion.variants_of(anchors, ("a", "b", "c"))
    assert [(r["group"], r["variant"]) for r in variants.orderBy("group", "place").collect()] == [("g1", "spring boot"), ("g1", "Spring-Boot"), ("g1", "springboot"), ("g2", "JNDI"), ("g2", "naming service"), ("g2", "이름 서비스"), ("g4", "@Bean"), ("g4", "bean factory"), ("g4", "x")]
    texts = spark.createDataFrame([(1, "my SPRING_boot app"), (2, "the springbootish app"), (3, "jndix unused"), (4, "이름서비스 and a @bean"), (5, None), (6, "JNDI, boot spring")], "doc_id long, text string")
    got = {}
    for r in expansion.expand(texts, variants).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["term"])
    assert got == {1: ["spring boot", "Spring-Boot", "springboot"], 2: ["spring boot", "Spring-Boot", "springboot"], 4: ["JNDI", "naming service", "이름 서비스", "@Bean", "bean factory", "x"], 6: ["JNDI", "naming service", "이름 서비스"]}
    assert expansion.expand(texts, variants, most=2).groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    whole = {r["doc_id"]: r["text"] for r in expansion.expanded_texts(texts, expansion.expand(texts, variants)).collect()}
    assert whole[6] == "JNDI, boot spring\nJNDI naming service 이름 서비스" and whole[5] == "" and whole[3] == "jndix unused"


def test_targets(spark):
    near = spark.createDataFrame([(1, [2, 1, 3], [9]), (2, [1], []), (3, [], [5]), (4, None, None)], "id long, near array<long>, far array<long>")
    plans = spark.createDataFrame([(i, s, a) for i in (1, 2, 3, 4, 5) for s, a in enumerate(["single", "near", "far"] * 30)], "chunk_id long, seq int, answerability string")
    rows = dataset.choose_targets(plans, near).collect()
    kinds = {(r["chunk_id"], w): set() for r in rows for w in ("single", "near", "far")}
    for r in rows:
        wanted = ["single", "near", "far"][r["seq"] % 3]
        kinds[r["chunk_id"], wanted].add((r["answerability"], tuple(r["targets"])))
    assert kinds[1, "near"] == {("near", (1, 2)), ("near", (1, 3))} and kinds[1, "far"] == {("far", (1, 9))} and kinds[2, "far"] == {("near", (2, 1))}
    assert kinds[3, "near"] == {("single", (3,))} and kinds[3, "far"] == {("far", (3, 5))} and kinds[4, "far"] == {("single", (4,))} and kinds[5, "near"] == {("single", (5,))}
    assert all(kinds[i, "single"] == {("single", (i,))} for i in range(1, 6))


def sequential(pages, links, starts, depth):
    """A crawl page by page."""
    queue, visited, hashes, documents, out = deque(), set(), set(), set(), {}
    for url, _ in sorted(starts, key=lambda s: (s[1], s[0])):
        queue.append((url, 0, None))
    while queue:
        url, level, parent = queue.popleft()
        if url in visited:
            continue
        visited.add(url)
        if url not in pages:
            out[url] = (level, parent, "missing")
            continue
        if level < depth:
            for _, target in sorted(links.get(url, [])):
                if target not in visited:
                    queue.append((target, level + 1, url))
        content, document = pages[url]
        if content in hashes:
            out[url] = (level, parent, "duplicate_content")
        elif document in documents:
            out[url] = (level, parent, "duplicate_document")
        else:
            hashes.add(content)
            documents.add(document)
            out[url] = (level, parent, "kept")
    return out


def as_found(df):
    rows = df.collect()
    assert len({r["url"] for r in rows}) == len(rows)
    return {r["url"]: (r["depth"], r["parent"], r["state"]) for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_crawl_is_that_of_a_sequential_one(spark, seed):
    g = random.Random(seed)
    names = [f"u{i:02d}" for i in range(40)]
    pages = {n: (f"h{g.randrange(14)}", f"d{g.randrange(18)}") for n in names[:34]}
    links = {n: [(i, g.choice(names)) for i in range(g.randrange(4))] for n in names}
    starts = [(n, i) for i, n in enumerate(g.sample(names, 3))]
    frames = (
        spark.createDataFrame([(u, *p) for u, p in pages.items()], "url string, content_hash string, document_id string"),
        spark.createDataFrame([(s, p, t) for s, x in links.items() for p, t in x], "source string, place long, target string"), spark.createDataFrame(starts, "url string, place long"),
    )
    first = {s: [(min(p for p, t in x if t == target), target) for target in {t for _, t in x}] for s, x in links.items()}
    for depth in (1, 9):
        assert as_found(crawl.crawl(*frames, depth=depth)) == sequential(pages, first, starts, depth)


def test_crawl_of_the_pages(spark):
    held, links, starts = G._site(spark, SF)
    pages = {r["url"]: (r["content_hash"], r["document_id"]) for r in held.orderBy(F.desc("content_hash")).collect()}
    own = {}
    for r in links.collect():
        own.setdefault(r["source"], {})
        own[r["source"]][r["target"]] = min(own[r["source"]].get(r["target"], 1 << 40), r["place"])
    expected = sequential(pages, {s: [(p, t) for t, p in x.items()] for s, x in own.items()}, [(r["url"], r["place"]) for r in starts.collect()], 4)
    got = as_found(registry.queries()["page_crawl"](spark, SF))
    assert got == expected and {s for _, _, s in got.values()} >= {"kept", "missing"}


def test_crawl_of_nothing(spark):
    held, links, starts = G._site(spark, SF)
    assert crawl.crawl(held, links, starts.where("false"), 3).count() == 0


def test_every_flag_and_every_broken_reference_occurs(spark):
    rows = registry.queries()["sample_flags"](spark, "/root/testdata/sf0.01").collect()
    assert {f for r in rows for f in r["flags"].split(",")} >= set("ABCDEF")
    found = {r["broken"] for r in registry.queries()["reference_audit"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {None, *audit.BROKEN}
    nothing = spark.createDataFrame([(1, None, None, None, None, None, None)], "sample_id long, query string, source_query string, source_type string, chunk_text string, section_path string, key_points array<string>")
    assert audit.flags(nothing).first()["flags"] == ["B", "F"]


def test_pairs_of_large_units_and_methods_of_each_side(spark, monkeypatch):
    """Counts and methods against pairs written out, with units above and below the size that is dealt over tasks."""
    from millrace.operators import relations

    monkeypatch.setattr(relations, "HOT", 3)
    terms = [(t, "concept" if t % 4 == 0 else "class", t != 9) for t in range(12)]
    links = [(u, t, None if (u + t) % 5 == 0 else f"m{(u * t) % 3}") for u in range(6) for t in range(12) if (u * 7 + t * 3) % 5 < u]
    links += [(3, 2, "m0"), (3, 2, "m2")]
    expected = {}
    for u in range(6):
        own = {t: {m for v, x, m in links if (v, x) == (u, t) and m} for v, t, _ in links if v == u and t != 9}
        for a, methods in own.items():
            for b in own:
                if a != b and (a % 4 or b % 4):
                    n, seen = expected.get((a, b), (0, set()))
                    expected[a, b] = n + 1, seen | methods
    frame = relations.shared_edges(spark.createDataFrame(links, "unit long, term long, method string"), spark.createDataFrame(terms, "term_id long, term_type string, active boolean"), "unit", relations.BY_QUERY)
    found = {(r["seed"], r["related"]): (r["evidence"], r["method"]) for r in frame.collect()}
    assert found == {k: (n, None if not m else "mixed" if len(m) > 1 else min(m)) for k, (n, m) in expected.items()}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan  # a set in the buffer makes Spark sort and spill every pair


def test_edges_within_limits_and_without_units(spark):
    """With limits the same edges stay as without them, in whatever parts a block is counted; a link without a unit shares none."""
    g = random.Random(5)
    links = [(u, f"t{min(int(g.expovariate(0.1)), 60)}", g.choice([None, "m0", "m1"]) if u % 3 else "m2") for u in range(90) for _ in range(g.choice([1, 3, 9]))]
    terms = spark.createDataFrame([(f"t{i}", "concept" if i % 4 == 0 else "class", i != 7) for i in range(70)], "term_id string, term_type string, active boolean")
    frame = spark.createDataFrame([*links, (None, "t1", "m0"), (None, "t2", "m0")], "unit long, term string, method string")
    kept = lambda df: sorted(map(str, relations.best_of_each(relations.Source("k", "s", df), 0.7, 2).collect()))
    every = relations.shared_edges(frame, terms, "unit", relations.BY_QUERY)
    limited = relations.shared_edges(frame, terms, "unit", relations.BY_QUERY, 0.7, 2)
    assert kept(limited) == kept(every) and limited.count() < every.count()
    own = {u: {t for v, t, _ in links if v == u and t != "t7"} for u in range(90)}
    expected = {}
    for held in own.values():
        for a in held:
            for b in held:
                if a != b and (int(a[1:]) % 4 or int(b[1:]) % 4):
                    expected[a, b] = expected.get((a, b), 0) + 1
    assert {(r["seed"], r["related"]): r["evidence"] for r in every.collect()} == expected
    assert limited.agg(F.min("score")).first()[0] >= 0.699


def test_units_and_pairs_in_pieces(monkeypatch):
    """What tasks count does not depend on how many rows, terms or pairs are taken at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    g = random.Random(6)
    links = sorted(((u, 2 * (t := min(int(g.expovariate(0.15)), 30)) + (t % 4 == 0), g.choice([None, 3, 8])) for u in range(60) for _ in range(g.choice([1, 4, 12]))), key=lambda r: r[0])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["u", "code", "part", "parts", "_h"])

    def counted(step, least=1, most=None):
        rows = list(relations._units(batch(links[i : i + step]) for i in range(0, len(links), step)))
        found, blocks = {}, {k for b in rows for k in b["block"].to_pylist()}
        for block in blocks:
            mine = [b.filter(pc.equal(b["block"], block)) for b in rows]
            for b in relations._counted(iter(mine), True, least, most):
                for r in b.to_pylist():
                    n, lo, hi = found.get((r["a"], r["b"]), (0, 99, -99))
                    found[r["a"], r["b"]] = (n + r["evidence"], min(lo, 99 if r["lo"] is None else r["lo"]), max(hi, -99 if r["hi"] is None else r["hi"]))
        return found

    expected = {}
    for u in range(60):
        own = {}
        for v, t, m in links:
            if v == u:
                own.setdefault(t, set()).update({m} - {None})
        for a, methods in own.items():
            for b in own:
                if a != b and not a & b & 1:
                    n, lo, hi = expected.get((a, b), (0, 99, -99))
                    expected[a, b] = (n + 1, min([lo, *methods]), max([hi, *methods]))
    assert counted(1000) == expected
    best = {}
    for (a, b), x in sorted(expected.items(), key=lambda r: (r[0][0], -r[1][0], r[0][1])):
        if x[0] >= 2 and sum(k[0] == a for k in best) < 3:
            best[a, b] = x
    assert counted(1000, 2, 3) == best
    for name, value in (("PIECE", 7), ("HOT", 3), ("BLOCK", 4), ("VISITS", 5)):
        monkeypatch.setattr(relations, name, value)
        assert counted(5) == expected and counted(5, 2, 3) == best
    monkeypatch.setattr(relations, "BLOCK", 1024)
    monkeypatch.setattr(relations, "ENTRIES", 20)
    assert counted(5, 2, 3) == expected  # more than fits together: all is passed on, to be added up


def test_the_index_builds_only_the_kinds_it_reads(spark):
    whole = G._built(spark, SF)
    kept = lambda df: sorted(map(str, relations.load(df, G._terms(spark, SF), "v1", G.INDEX_KINDS, G.INDEX_FLOOR).collect()))
    built = G._built(spark, SF, G.INDEX_KINDS)
    assert kept(built) == kept(whole)
    assert {r["kind"] for r in built.select("kind").distinct().collect()} <= set(G.INDEX_KINDS)
