"""Conversation structure repair: a time-major tensor DP over buckets of conversations of like length.

A repaired conversation has roles that begin with ``(s?(ua)+)?``. Edits of a row are Delete, Keep and
Rerole; Insert puts an empty user or assistant row before or behind any. What has been kept leaves one of
four states: nothing yet, system, user, assistant. Within a task, conversations of like length are
stacked into tensors ``[turn, conversation, state]``. The pass from the last turn to the first updates
the costs of all of them at each turn and stores them; the pass forward takes, at each turn, the edits
that still lead to the least cost, the ASCII-least initial first, for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import small_batches, starts_of, tidied

SPACES = " \t\n\x0b\x0c\r"
DELETE, KEEP, REROLE, INSERT, TRUNCATED = 2, 0, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or re-roled row leads from each state: user, user, assistant, user.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
NEVER = np.int64(1) << 40
#: Codes of role initials; others are 0. A kept row of code c leads from state s to LEADS[s, c], -1 if it may not.
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEADS = np.full((4, 4), -1)
LEADS[START, SYSTEM], LEADS[START, USER], LEADS[SYSTEM, USER], LEADS[USER, ASSISTANT], LEADS[ASSISTANT, USER] = SYSTEM, USER, USER, ASSISTANT, USER
#: Pairs of codes that may stand side by side before the repair.
BESIDE = LEADS[1:] >= 0
#: Rows or bytes of text of whole conversations that a task works on together; turns by conversations of one tensor.
HELD_ROWS, HELD_BYTES, CELLS = 1 << 16, 32 << 20, 1 << 20
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role: string, text: string>>"


def damage_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by a checksum of conversation and turn: (id, turn, role, text, present).

    Of 20 remainders 0 drops a row (it stays, not ``present``, to name its conversation), 1 empties its
    text, 2 takes sentence marks out, 3 repeats it, 4 makes it the user's; the rest stay. Null texts and
    roles, and null ids and turns in the checksum, are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col))) % 20).alias("_t_fault")
    rows = turns.select(F.col(id_col), F.col(turn_col), blank(role_col).alias(role_col), blank(text_col).alias(text_col), fault)
    text = F.when(F.col("_t_fault") == 1, "").when(F.col("_t_fault") == 2, F.translate(F.col(text_col), ".!?", "")).otherwise(F.col(text_col))
    changed = rows.select(
        id_col, turn_col, F.when(F.col("_t_fault") == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col), (F.col("_t_fault") != 0).alias("present"),
        F.explode(F.when(F.col("_t_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_t_copy"),
    )
    return changed.drop("_t_copy")


def backward_costs(codes: np.ndarray, marks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``[turn + 1, conversation, state]``: the least cost of what is left, rows before that turn done.

    ``codes`` and ``marks`` are ``[turn, conversation]``: role initials, and 0 for a sound row, 1 for a
    truncated one, 2 for one that has to go. Turns past a conversation's length change nothing.
    """
    turns, many = codes.shape

    def with_inserts(cost: np.ndarray) -> np.ndarray:
        user, assistant = np.minimum(cost[:, USER], INSERT + cost[:, ASSISTANT]), np.minimum(cost[:, ASSISTANT], INSERT + cost[:, USER])
        return np.stack([np.minimum(cost[:, START], INSERT + user), np.minimum(cost[:, SYSTEM], INSERT + user), user, assistant], axis=1)

    out = np.empty((turns + 1, many, 4), np.int64)
    out[turns] = with_inserts(np.tile(np.array([0, NEVER, NEVER, 0]), (many, 1)))
    for t in range(turns - 1, -1, -1):
        later = out[t + 1]
        kept, reroled = _kept(later, codes[t], marks[t]), _reroled(later, marks[t])
        step = with_inserts(np.minimum(DELETE + later, np.minimum(kept, reroled)))
        out[t] = np.where((t < lengths)[:, None], step, later)
    return out


def _kept(later: np.ndarray, code: np.ndarray, mark: np.ndarray) -> np.ndarray:
    leads = LEADS[:, code].T
    cost = np.take_along_axis(later, np.maximum(leads, 0), axis=1) + KEEP + TRUNCATED * (mark == 1)[:, None]
    return np.where((leads >= 0) & (mark < 2)[:, None], cost, NEVER)


def _reroled(later: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return np.where((mark < 2)[:, None], later[:, NEXT] + REROLE + TRUNCATED * (mark == 1)[:, None], NEVER)


def trace_edits(costs: np.ndarray, codes: np.ndarray, marks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits ``[step, conversation]`` as ASCII codes of their initials (0: none), three steps a turn, and the state after each.

    Each step takes the least initial that keeps the cost least; two inserts at most come before a turn,
    since a third would be back in the state of the first.
    """
    turns, many = codes.shape
    edits, states = np.zeros((3 * turns + 3, many), np.uint8), np.zeros((3 * turns + 3, many), np.int8)
    state, at = np.zeros(many, np.int64), np.arange(many)
    for t in range(turns + 1):
        waits = t < lengths if t < turns else np.zeros(many, bool)
        if t < turns:
            later = costs[t + 1]
            kept, reroled = _kept(later, codes[t], marks[t]), _reroled(later, marks[t])
        for r in range(3):
            least = costs[t][at, state]
            # a conversation that has ended earlier waits, with its inserts, for the last place
            insert = (least > 0) & (INSERT + costs[t][at, NEXT[state]] == least) if t == turns else waits & (INSERT + costs[t][at, NEXT[state]] == least)
            edit = np.where(insert, ord("I"), 0)
            if t < turns:
                delete = waits & (DELETE + later[at, state] == least)
                keep = waits & ~delete & ~insert & (kept[at, state] == least)
                edit = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), np.where(waits, ord("R"), 0))))
                state = np.where(edit == ord("K"), LEADS[state, codes[t]], state)
                waits = waits & (edit == ord("I"))
            state = np.where((edit == ord("I")) | (edit == ord("R")), NEXT[state], state)
            edits[3 * t + r], states[3 * t + r] = edit, state
    return edits, states


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    null = pc.and_(pc.is_null(before), pc.is_null(after))
    return ~pc.if_else(null, True, pc.fill_null(pc.equal(before, after), False)).to_numpy(zero_copy_only=False)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def repair_batch(rows: pa.Table) -> dict[str, pa.Array]:
    """Columns of the result for whole conversations, sorted: id, turn, role, text, blank, cut, initial, present."""
    ids, turn, role, text = (rows.column(i).combine_chunks() for i in range(4))
    blank, cut, code, present = (rows.column(i).to_numpy() for i in range(4, 8))
    first = np.concatenate([[True], _changes(ids)]) if rows.num_rows else np.zeros(0, bool)
    names = ids.take(pa.array(np.flatnonzero(first)))
    conv, many = np.cumsum(first) - 1, len(names)
    # from here on the rows that are there
    here = np.flatnonzero(present)
    conv, blank, cut, code = conv[here], blank[here], cut[here], code[here]
    turn, role, text = (c.take(pa.array(here)) for c in (turn, role, text))
    lengths = np.bincount(conv, minlength=many)
    starts = np.concatenate([[0], np.cumsum(lengths)])

    said = np.stack([conv, _numbers(role.dictionary_encode().indices), _numbers(text.dictionary_encode().indices)])
    order = np.lexsort(said[::-1])  # stable: the first of equal rows stays the first
    again = np.zeros(len(here), bool)
    again[order[1:]] = (said[:, order[1:]] == said[:, order[:-1]]).all(axis=0)
    fault = np.where(blank, 1, np.where(again, 2, np.where(cut, 3, 0)))
    count = lambda hit: np.bincount(conv[hit], minlength=many)

    known = np.flatnonzero(turn.is_valid().to_numpy(zero_copy_only=False))
    number, owner = _numbers(turn)[known], conv[known]
    edges = starts_of(owner)
    gaps = np.zeros(many, np.int64)
    if len(known):
        fresh = np.concatenate([[True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])])
        gaps[owner[edges[:-1]]] = number[edges[1:] - 1] - number[edges[:-1]] + 1 - np.add.reduceat(fresh, edges[:-1])
    side = np.flatnonzero(conv[1:] == conv[:-1]) if len(conv) else np.zeros(0, np.int64)
    legal = np.where((code[side] > 0) & (code[side + 1] > 0), BESIDE[np.maximum(code[side] - 1, 0), code[side + 1]], False)

    cost = np.zeros(many, np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    width = np.where(lengths > 0, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64), 0)
    for turns in np.unique(width):
        bucket = np.flatnonzero(width == turns)
        for a in range(0, len(bucket), max(1, CELLS // max(turns, 1))):
            own = bucket[a : a + max(1, CELLS // max(turns, 1))]
            longest = int(lengths[own].max(initial=0))
            place = starts[own][None, :] + np.arange(longest)[:, None]
            inside = np.arange(longest)[:, None] < lengths[own][None, :]
            place = np.where(inside, place, 0)
            codes, marks = (np.where(inside, x[place], 0) if len(here) else place for x in (code, np.array([0, 2, 2, 1])[fault]))
            costs = backward_costs(codes, marks, lengths[own])
            cost[own] = costs[0, :, START]
            edits, states = trace_edits(costs, codes, marks, lengths[own])
            which, step = np.nonzero(edits.T)
            parts.append((own[which], edits[step, which], starts[own[which]] + step // 3, states[step, which]))
    owner, edit, row, state = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    order = np.argsort(owner, kind="stable")
    owner, edit, row, state = owner[order], edit[order], row[order], state[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=many))])
    audit = [edit[ends[i] : ends[i + 1]].astype(np.uint8).tobytes().decode("ascii") for i in range(many)]

    stays = edit != ord("D")
    owner, edit, row, state = owner[stays], edit[stays], row[stays], state[stays]
    new, made = edit == ord("I"), edit != ord("K")
    source = pa.array(np.where(new, 0, row), mask=new)
    given = pa.array(np.array(["", "", ROLE_OF[USER], ROLE_OF[ASSISTANT]], object)[state.astype(np.int64)], pa.string())
    final = pc.if_else(pa.array(made), given, role.take(source).cast(pa.string()))
    said = pc.fill_null(text.take(source).cast(pa.string()), "")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=many))])
    repaired = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([final, said], names=["role", "text"]))
    numbers = {"gaps": gaps, "blank": count(fault == 1), "duplicate": count(fault == 2), "truncated": count(fault == 3), "illegal": np.bincount(conv[side[~legal]], minlength=many), "cost": cost}
    return {"id": names, **{k: pa.array(v, pa.int64()) for k, v in numbers.items()}, "audit": pa.array(audit, pa.string()), "repaired": repaired}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations from rows sorted by id, as many as are worked on together."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (rows >= HELD_ROWS or size >= HELD_BYTES):
            ids = pa.chunked_array([held[-1].column(0).slice(held[-1].num_rows - 1), batch.column(0)]).combine_chunks()
            new = np.flatnonzero(_changes(ids))
            if len(new):  # the rest of a conversation that began before goes with it
                yield pa.Table.from_batches([*held, batch.slice(0, int(new[0]))])
                batch = batch.slice(int(new[0]))
                held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row for each conversation: id, counts of faults, ``cost``, ``audit`` and the ``repaired`` turns.

    Rows are taken by turn (nulls first), then role, then text, so ties and repeated rows have one order;
    null roles and texts are one space; rows without an id are one conversation. A row's first fault counts:
    ``blank``, ``duplicate`` (role and text stood before), ``truncated`` (its last sign is none of ``.!?``).
    ``gaps`` are turns that are missing between the first and the last; ``illegal`` are neighbours whose
    role initials are not su, ua or au. A role whose initial is another, or none, can't be kept. Rows where
    ``present_col`` is false only name their conversation; one without other rows, like an empty one, has
    zeros, an empty audit and no turns. An empty table gives an empty one; other columns are not read.

    One shuffle by id. A task streams its sorted rows and holds whole conversations up to ``HELD_ROWS`` or
    ``HELD_BYTES``, besides one longer than that alone: a conversation is one row of the result, so it has
    to fit into a task (its texts, and some 60 bytes a turn).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(id_col).alias("_t_id"), F.col(turn_col).cast("long").alias("_t_turn"), space(role_col).alias("_t_role"), space(text_col).alias("_t_text"),
        F.coalesce(F.col(present_col), F.lit(True)).alias("_t_here") if present_col else F.lit(True).alias("_t_here"),
    )
    last: Column = F.rtrim(F.col("_t_text"), F.lit(SPACES))
    initial = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in INITIALS.items() for x in pair)), F.left(F.col("_t_role"), F.lit(1))), F.lit(0))
    dealt = rows.repartition("_t_id").sortWithinPartitions("_t_id", F.asc_nulls_first("_t_turn"), "_t_role", "_t_text")
    marked = dealt.select("_t_id", "_t_turn", "_t_role", "_t_text", (last == "").alias("_t_blank"), (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("_t_cut"), initial.alias("_t_initial"), "_t_here")
    kind = marked.schema["_t_id"].dataType.simpleString()
    schema = marked.select(F.col("_t_id").alias("id")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _conversations(batches):
            out = repair_batch(table)
            out["id"] = out["id"].cast(arrow.field("id").type)
            yield from pa.table(out).to_batches()

    small_batches(turns.sparkSession)
    return marked.mapInArrow(tidied(run), f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def repair_digest(repaired: DataFrame) -> DataFrame:
    """The rows of :func:`repair_conversations` with a digest of ``role:text`` lines for their turns."""
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return repaired.select(*(c for c in repaired.columns if c != "repaired"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
