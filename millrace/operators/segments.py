"""Segments of Markdown texts for translation: code and blank lines apart, long prose cut between sentences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a text segment should not exceed; a longer sentence stays whole.
MOST = 900
HEADING = re.compile(r"\s{0,3}#{1,6}\s+")
ITEM = re.compile(r"\s*(?:[-*+]\s+|\d+[.)]\s+)")
BETWEEN = re.compile(r"(?<=[.!?。！？])\s+")


def line_kind(line: str) -> str:
    """code (a fence), blank, single (a heading, table row or list item) or prose."""
    bare = line.strip()
    if bare.startswith(("```", "~~~")):
        return "code"
    if not bare:
        return "blank"
    return "single" if bare.startswith("|") or HEADING.match(line) or ITEM.match(line) else "prose"


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` without gaps: fenced code whole, each blank, heading, row and item line alone, runs of prose lines."""
    at, begun, state = 0, 0, None
    for line in text.splitlines(keepends=True):
        kind, end = line_kind(line), at + len(line)
        if state == "code":
            if kind == "code":
                yield "code", begun, end
                begun, state = end, None
        elif kind == "prose":
            if state is None:
                begun, state = at, "prose"
        else:
            if state == "prose":
                yield "prose", begun, at
            begun, state = at, "code" if kind == "code" else None
            if state is None:
                yield kind, at, end
                begun = end
        at = end
    if state is not None:
        yield state, begun, at


def packed(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Spans of whole sentences, each as long as ``most`` allows."""
    cuts = [m.end() for m in BETWEEN.finditer(text, start, end)] if end - start > most else []
    begun = last = start
    for cut in [*cuts, end]:
        if cut - begun > most and last > begun:
            yield begun, last
            begun = last
        last = cut
    if end > begun:
        yield begun, end


def segments(text: str | None, most: int = MOST) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of each segment, kind code, blank or text; joined they give the text again."""
    out = []
    for kind, start, end in blocks(text or ""):
        if kind in ("code", "blank"):
            out.append((kind, start, end))
        else:
            out += [("text", s, e) for s, e in packed(text, start, end, most)]
    return out


def segmented(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``(doc_id, place, kind, start, end, text, sha256)``: the segments of every text, in one narrow pass. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, i, kind, s, e, text[s:e]) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (kind, s, e) in enumerate(segments(text, most))]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()))]
            digests = pa.array([hashlib.sha256(r[5].encode()).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, digests], names=["doc_id", "place", "kind", "start", "end", "text", "sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, place int, kind string, start int, end int, text string, sha256 string")
