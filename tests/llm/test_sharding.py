"""Sharding: the capacity against a plain dynamic program, laws of the result, odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, sharding


def plain_capacity(sizes, shards):
    """The least capacity for which the sizes, in order, fit into that many runs; one larger size has a run alone.

    Tried from every sum that a run may have, smallest first, with the fewest runs by dynamic programming.
    """
    sums = {0} | {sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}
    for capacity in sorted(sums):
        fewest = [0] + [10**9] * len(sizes)
        for j in range(1, len(sizes) + 1):
            for i in range(j):
                if i == j - 1 or sum(sizes[i:j]) <= capacity:
                    fewest[j] = min(fewest[j], fewest[i] + 1)
        if fewest[-1] <= shards:
            return capacity
    raise AssertionError


def as_groups(spark, sizes):
    ends, total = [], 0
    for i, size in enumerate(sizes):
        total += size
        ends.append((f"{i:08d}", total, 1))
    return spark.createDataFrame(ends, "key string, end long, rows long")


@pytest.mark.parametrize("seed", range(6))
def test_capacity_and_cuts(spark, seed):
    g = random.Random(seed)
    for shards in (1, 3, 5):
        sizes = [g.choice([1, 1, 2, 3, 7, 30] + [200] * (seed % 2)) for _ in range(g.randrange(1, 22))]
        groups = as_groups(spark, sizes).cache()
        expected = plain_capacity(sizes, shards)
        found = {buckets: sharding.find_cuts(groups, shards, buckets) for buckets in (4, 1 << 16)}
        assert found[4] == found[1 << 16] and found[4][0] == expected, (sizes, shards)
        cuts = [0, *found[4][1]]
        ends = [0, *(sum(sizes[: i + 1]) for i in range(len(sizes)))]
        assert cuts[-1] == ends[-1] and len(cuts) == shards + 1 and cuts == sorted(cuts) and set(cuts) <= set(ends)
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert b - a <= expected or sum(a < e <= b for e in ends) == 1
        groups.unpersist()


def test_one_huge_group_leaves_the_others_even(spark):
    sizes = [5] * 300 + [4000] + [5] * 500
    capacity, cuts = sharding.find_cuts(as_groups(spark, sizes), 16, 8)
    loads = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert max(loads) == 4000 and capacity == 280 and min(loads) >= 245 and sum(loads) == 8000


def test_large_tables_take_several_rounds(spark):
    """Prefix sums drawn finer, again and again, give the same cuts as all of them at once."""
    groups = spark.range(20_000).select(F.format_string("%08d", "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(5000)) + 1).alias("size"))
    from pyspark.sql import Window

    ends = groups.select("key", F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)).alias("end"), F.lit(1).alias("rows")).cache()
    capacity, cuts = sharding.find_cuts(ends, 16, buckets=64)
    assert (capacity, cuts) == sharding.find_cuts(ends, 16)
    loads = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert max(loads) <= capacity and max(loads) - min(loads) < 10_000
    # one less doesn't fit: greedily, from all prefix sums
    every, at = [r["end"] for r in ends.orderBy("end").collect()], 0
    import bisect

    for _ in range(16):
        at = every[bisect.bisect_right(every, at + capacity - 1) - 1]
    assert at < every[-1]
    ends.unpersist()


def check_laws(rows, given):
    """What holds for any result; ``given`` are the (id, text) that went in."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark):
    g = random.Random(3)
    texts = [None, "", "é" * 50, *(f"text {g.random()} " * g.randrange(1, 60) for _ in range(400))]
    given = [(i, g.choice(texts[-30:]) if i % 3 == 0 else g.choice(texts)) for i in range(3000)] + [(None, "x"), (None, "x"), (1, "twice"), (1, "twice")]
    docs = spark.createDataFrame(given, "doc_id long, text string").select("*", *(F.lit("mine").alias(c) for c in ("key", "slot", "shard", "_s_key", "a.b c", "n")))
    out = sharding.shard_rows(docs)
    assert out.columns == ["doc_id", "text", "key", "_s_key", "a.b c", "n", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    check_laws(rows, given)
    homes = defaultdict(set)
    for r in rows:
        homes[r["text"] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    loads, groups = Counter(), Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
        groups[r["text"] or ""] += r["size"]
    order = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(homes[t].copy().pop() for t in order) == [homes[t].copy().pop() for t in order]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 2 * max(groups.values())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_rows(docs.repartition(3), buckets=16).collect()))


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string"
    assert sharding.shard_rows(spark.createDataFrame([], schema)).count() == 0
    for given in ([(1, None)], [(1, "a"), (2, "b")], [(i, "same") for i in range(500)], [(i, None if i % 2 else "") for i in range(90)], [(1, "long " * 400_000), (2, "s")]):
        rows = sharding.shard_rows(spark.createDataFrame(given, schema)).collect()
        check_laws(rows, given)
    out = sharding.shard_rows(spark.createDataFrame([(i, f"t{i}") for i in range(300)], schema), shards=4)
    sharding.write_shards(out, str(tmp_path / "shards"), files_of_shard=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(*sorted(back.columns)).collect())) == sorted(map(str, out.select(*sorted(out.columns)).collect()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op11_sharding(spark, sf).collect()
    check_laws(rows, given)
    text = dict(given)
    groups = defaultdict(int)
    for i, t in given:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    ordered = [groups[k] for k in sorted(groups)]
    loads, homes = Counter(), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        assert homes.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    capacity = sharding.find_cuts(as_groups(spark, ordered), 16)[0]

    def fits(c):
        runs, load = 0, None
        for size in ordered:
            if load is None or load + size > c:
                runs, load = runs + 1, size
            else:
                load += size
        return runs <= 16

    assert fits(capacity) and not fits(capacity - 1) and max(loads.values()) <= max(capacity, max(ordered))
