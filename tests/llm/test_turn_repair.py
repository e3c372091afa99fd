"""Conversation repair against a plain search over edits, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, turn_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, present boolean"


def cheapest(rows):
    """Least (cost, audit) by a search over whole edit sequences: Dijkstra with audits as tie-breakers."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, shape = heapq.heappop(heap)
        if (at, shape) in done:
            continue
        done.add((at, shape))
        if at == len(rows) and shape in ("", "a"):
            return cost, audit
        steps = []
        new = "a" if shape == "u" else "u"
        steps.append((5, "I", at, new))
        if at < len(rows):
            initial, fault = rows[at]
            steps.append((2, "D", at + 1, shape))
            if fault in ("sound", "truncated"):
                more = 5 * (fault == "truncated")
                if (initial == "s" and shape == "") or (initial == "u" and shape in ("", "s", "a")) or (initial == "a" and shape == "u"):
                    steps.append((more, "K", at + 1, initial))
                steps.append((1 + more, "R", at + 1, new))
        for price, letter, there, then in steps:
            heapq.heappush(heap, (cost + price, audit + letter, there, then))
    raise AssertionError


def plain(conversation):
    """The result for one conversation's (turn, role, text, present)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x, here in conversation if here]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, seen, faults = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "sound"
        seen.add((role, text))
        faults.append(fault)
        if fault != "sound":
            counts[fault] += 1
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    lines, at, shape = [], 0, ""
    for letter in audit:
        new = "a" if shape == "u" else "u"
        role = {"u": "user", "a": "assistant"}[new]
        if letter == "I":
            lines.append(f"{role}:")
            shape = new
            continue
        if letter == "K":
            lines.append(f"{rows[at][1]}:{rows[at][2]}")
            shape = rows[at][1][:1]
        if letter == "R":
            lines.append(f"{role}:{rows[at][2]}")
            shape = new
        at += 1
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def compare(spark, rows):
    by_id = {}
    for conv, *row in rows:
        by_id.setdefault(conv, []).append(tuple(row))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: r.asDict() for r in turn_repair.repair_digest(turn_repair.repair_conversations(frame, present_col="present")).collect()}
    assert set(found) == set(by_id)
    for conv, given in by_id.items():
        got = found[conv]
        assert got.pop("conv_id") == conv
        assert got == plain(given), (conv, given)


def draw(g, conv, most):
    words = ["Yes.", "No", "", " \n", "What?", "Yes. \t", "Go on!", "é。", "a.b"]
    for _ in range(g.randrange(most)):
        yield conv, g.choice([None, *range(6)]), g.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), g.choice([*words, None, f"w{g.random()}.", f"w{g.random()}."]), g.random() < 0.9


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    g = random.Random(seed)
    rows = [r for conv in [None, *range(-2, 200)] for r in draw(g, conv, 14)]
    compare(spark, rows)


def test_long_conversations_over_many_batches(spark, monkeypatch):
    """Rows of one conversation come in several Arrow batches, and several tensors share a bucket."""
    g = random.Random(9)
    for name, value in (("HELD_ROWS", 300), ("CELLS", 1 << 9)):
        monkeypatch.setattr(turn_repair, name, value)  # in this process; the generator below runs here too
    rows = [r for conv in range(40) for r in draw(g, conv, 1500 if conv % 9 == 0 else 20)]
    compare(spark, rows)
    import pyarrow as pa

    ordered = sorted(((i, t, r or "", x or "") for i, t, r, x, _ in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
    columns = [pa.array([r[k] for r in ordered]) for k in range(4)]
    more = [pa.array([False] * len(ordered)), pa.array([False] * len(ordered)), pa.array([turn_repair.INITIALS.get(r[2][:1], 0) for r in ordered], pa.int32()), pa.array([True] * len(ordered))]
    batch = pa.RecordBatch.from_arrays([*columns, *more], names=[str(i) for i in range(8)])
    whole = turn_repair.repair_batch(pa.Table.from_batches([batch]))
    pieces = [turn_repair.repair_batch(t) for t in turn_repair._conversations(batch.slice(i, 7) for i in range(0, len(ordered), 7))]
    assert len(pieces) > 3
    for name in ("id", "cost", "audit", "repaired"):
        assert pa.concat_arrays([p[name] for p in pieces]).to_pylist() == whole[name].to_pylist()


def test_known_repairs(spark):
    say = lambda conv, *rows: [(conv, t, *r, True) for t, r in enumerate(rows)]
    u, a, s = ("user", "Why?"), ("assistant", "So."), ("system", "Be kind.")
    rows = [*say(1, s, u, a), *say(2, a), *say(3, u), *say(4, u, ("user", "And?"), a), *say(5, s), *say(6, u, a, ("user", "Cut off")), *say(7, ("x", "a."), ("y", "b."), ("z", "c.")), *say(8, u, a, u, a)]
    found = {r["conv_id"]: r for r in turn_repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: (r["audit"], r["cost"]) for i, r in found.items()} == {1: ("KKK", 0), 2: ("D", 2), 3: ("D", 2), 4: ("DKK", 2), 5: ("D", 2), 6: ("KKD", 2), 7: ("DRR", 4), 8: ("KKDD", 4)}
    assert [(t["role"], t["text"]) for t in found[7]["repaired"]] == [("user", "b."), ("assistant", "c.")]
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["repaired"])) for r in found.values())
    # an insert is worth it between two rows that would cost more otherwise: none here, so none is made
    assert not any("I" in r["audit"] for r in found.values())


def test_inserts_where_they_are_cheapest(monkeypatch):
    """With dear deletions the search has to insert; the tensors agree with the plain one."""
    import numpy as np

    for edit in ("DELETE", "REROLE"):
        monkeypatch.setattr(turn_repair, edit, 50)
    codes = np.array([[1], [3], [2]])
    costs = turn_repair.backward_costs(codes, np.zeros((3, 1), int), np.array([3]))
    edits, _ = turn_repair.trace_edits(costs, codes, np.zeros((3, 1), int), np.array([3]))
    assert "".join(chr(x) for x in edits[:, 0] if x) == "KIKKI" and costs[0, 0, 0] == 10


def test_damage(spark):
    rows = [(c, t, None if t == 3 else "system" if t == 0 else "user", None if t == 5 else f"Hi. {t}?") for c in range(40) for t in range(8)] + [(None, None, "user", "x."), (7, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("present", F.lit(False))
    got = sorted((tuple(r) for r in turn_repair.damage_turns(turns).collect()), key=str)
    expected = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        expected += [(c, t, "user" if k == 4 else role, text, k != 0)] * (2 if k == 3 else 1)
    assert got == sorted(expected, key=str)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_conversations(empty, present_col="present").count() == 0
    assert turn_repair.damage_turns(empty).count() == 0
    rows = [(1, 0, "user", "word " * 200_000 + "end.", True), (1, 1, "assistant", " " * 300_000 + "x.", True), (2, 0, "user", None, None)]
    odd = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("audit", "cost", "id", "_t_id", "a.b c")))
    got = {r["conv_id"]: r for r in turn_repair.repair_conversations(odd).collect()}
    assert got[1]["audit"] == "KK" and got[2]["audit"] == "D" and got[2]["blank"] == 1
    gone = turn_repair.repair_digest(turn_repair.repair_conversations(spark.createDataFrame([(3, 0, "user", "Hi.", False)], SCHEMA), present_col="present")).first().asDict()
    assert gone == {"conv_id": 3, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_query_against_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    damaged = turn_repair.damage_turns(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    by_id = {}
    for r in damaged:
        by_id.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["present"]))
    got = {r["conv_id"]: r.asDict() for r in queries.op12_repair(spark, sf).collect()}
    assert {c: {**plain(rows), "conv_id": c} for c, rows in by_id.items()} == got
