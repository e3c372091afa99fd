"""Sections to chunks: segments, boundaries, overlap, records.

A document is one row with its sections as an array, so chunking is a narrow stage (no shuffle); a
document's segments are a list with prefix sums of token counts, and chunks are cuts in that list.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH_TOKEN = re.compile(r"[A-Za-z0-9_./:@$-]+|[^\w\s]")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")

SECTION = "struct<section_id:string,section_path:string,blocks:array<struct<type:string,text:string,items:array<string>,rows:array<array<string>>,language:string>>>"
CHUNK = "document_id string, chunk_id string, chunk_index int, section_id string, section_path string, content string, char_len int, token_len int, base_token_len int, overlap_token_len int, code boolean, previous_chunk_id string, next_chunk_id string, reason string"


@dataclass(frozen=True)
class ChunkConfig:
    """Token budgets."""

    target_min: int = 400
    target_max: int = 900
    overlap_min: int = 80
    overlap_target: int = 100
    overlap_max: int = 120
    later_min: int = 300
    base_max: int = 780
    preferred: int = 640
    segment_max: int = 110
    label: str = "Overlap context from previous chunk:"


def length(text: str) -> int:
    return sum(1 for _ in LENGTH_TOKEN.finditer(text))


def tail(text: str, tokens: int) -> str:
    """From the ``tokens``-th last token on; the whole text if it has no more, or for no tokens."""
    starts = [m.start() for m in LENGTH_TOKEN.finditer(text)]
    return (text if tokens <= 0 or len(starts) <= tokens else text[starts[-tokens] :]).strip()


def packed(parts: list[str], most: int, joint: str) -> list[str]:
    """Neighbouring parts joined while they fit; a part that alone is too long is cut into words."""
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            out.append(joint.join(held).strip())
            held.clear()
        size = 0

    for part in filter(None, (p.strip() for p in parts)):
        n = length(part)
        if n > most and joint != " ":
            close()
            out.extend(packed(part.split(), most, " "))
            continue
        if held and size + n > most:
            close()
        held.append(part)
        size += n
    close()
    return out


def block_texts(block: dict, most: int) -> list[str]:
    """Texts of a block's segments: list items, table rows, code lines, or sentences are kept together."""
    kind, text = block.get("type") or "paragraph", (block.get("text") or "").strip()
    if kind == "list":
        return packed([f"- {' '.join(i.split())}" for i in (block.get("items") if block.get("items") is not None else []) if i and i.strip()], most, "\n")
    if kind == "table":
        return packed([" | ".join(" ".join((c or "").split()) for c in r) for r in (block.get("rows") if block.get("rows") is not None else []) if any(c and c.strip() for c in r)], most, "\n")
    if kind == "code":
        fence, out, held, size = f"```{block.get('language') or ''}", [], [], 0
        for line in (x.rstrip() for x in (block.get("text") or "").splitlines()):
            n = length(line)
            if held and size + n > most:
                out.append(held)
                held, size = [], 0
            held.append(line)
            size += n
        return ["\n".join([fence, *lines]).rstrip() + "\n```" for lines in [*out, held] if lines]
    if length(text) <= most:
        return [text] if text else []
    sentences = [s for s in (p.strip() for p in SENTENCE_END.split(text)) if s]
    return packed(sentences, most, "\n") if len(sentences) > 1 else packed(text.split(), most, " ")


@dataclass
class Segment:
    section: int
    kind: str
    text: str
    tokens: int


def segments_of(sections: list[dict], config: ChunkConfig) -> list[Segment]:
    out = []
    for k, section in enumerate(sections):
        heading = f"Section Path: {section['section_path']}"
        out.append(Segment(k, "heading", heading, length(heading)))
        for block in section["blocks"] if section["blocks"] is not None else []:
            out += [Segment(k, block.get("type") or "paragraph", t, length(t)) for t in block_texts(block, config.segment_max) if t]
    return out


def cut_points(segments: list[Segment], config: ChunkConfig) -> list[int]:
    """Places where chunks begin, and the end: first cuts, then splitting, moving and removing cuts."""
    total = [0]
    for s in segments:
        total.append(total[-1] + s.tokens)
    size = lambda a, b: total[b] - total[a]
    least = lambda i: config.later_min if i else config.target_min
    cuts = [0]
    for k in range(1, len(segments)):
        have = size(cuts[-1], k)
        if have >= least(len(cuts) - 1) and ((segments[k].kind == "heading" and have >= config.preferred) or size(cuts[-1], k + 1) > config.base_max):
            cuts.append(k)
    cuts.append(len(segments))

    def halves(a: int, b: int) -> list[int]:
        """Cuts inside an oversize chunk, each nearest to the preferred size, headings favoured."""
        options = [(abs(config.preferred - size(a, k)) + (0 if segments[k].kind == "heading" else 15), k) for k in range(a + 1, b) if min(size(a, k), size(k, b)) >= config.later_min]
        if size(a, b) <= config.base_max or not options:
            return []
        k = min(options)[1]
        return [*halves(a, k), k, *halves(k, b)]

    cuts = sorted({*cuts, *(k for a, b in zip(cuts, cuts[1:], strict=False) for k in halves(a, b))})
    for i in range(1, len(cuts) - 1):  # a short chunk takes segments from the one before, while that keeps its least
        while size(cuts[i], cuts[i + 1]) < least(i) and cuts[i] - cuts[i - 1] > 1 and size(cuts[i - 1], cuts[i] - 1) >= least(i - 1):
            cuts[i] -= 1
    i = 0
    while len(cuts) > 2 and i < len(cuts) - 1:  # what is still short joins the neighbour that then is nearer the preferred size
        here = size(cuts[i], cuts[i + 1])
        if here >= least(i):
            i += 1
            continue
        last, first = i == len(cuts) - 2, i == 0
        back = not first and (last or abs(config.preferred - size(cuts[i - 1], cuts[i + 1])) <= abs(config.preferred - size(cuts[i], cuts[i + 2])))
        del cuts[i if back else i + 1]
        i = max(0, i - 1)
    return cuts


def chunk_records(document_id: str, sections: list[dict], config: ChunkConfig = ChunkConfig()) -> list[tuple]:
    """Chunk rows of one document, in the order of ``CHUNK``."""
    segments = segments_of(sections, config)
    if not segments:
        return []
    cuts = cut_points(segments, config)
    ids = ["chk_" + hashlib.sha1(f"{document_id}:{k}".encode()).hexdigest()[:16] for k in range(len(cuts) - 1)]
    rows, before = [], ""
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        base = "\n\n".join(s.text for s in segments[a:b]).strip()
        base_len, overlap = length(base), ""
        if k:
            room = max(0, config.target_max - base_len - length(config.label) - 1)
            overlap = tail(before, min(config.overlap_target, room))
            if length(overlap) < config.overlap_min:
                overlap = tail(before, min(config.overlap_max, room))
        content = f"{config.label}\n{overlap}\n\n{base}".strip() if overlap else base
        n, shared = length(content), length(overlap)
        reason = None if n >= config.target_min else "document_too_short" if len(ids) == 1 else "overlap_constrained" if shared < config.overlap_min else None
        first = sections[segments[a].section]
        rows.append((document_id, ids[k], k, first["section_id"], first["section_path"], content, len(content), n, base_len, shared, any(s.kind == "code" for s in segments[a:b]), ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None, reason))
        before = base
    return rows


def gather_sections(sections: DataFrame) -> DataFrame:
    """``(document_id, sections)`` from rows ``(document_id, section_order, section_id, section_path, blocks)``."""
    row = F.struct("section_order", "section_id", "section_path", "blocks")
    return sections.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda s: F.struct(s["section_id"], s["section_path"], s["blocks"])).cast(f"array<{SECTION}>").alias("sections"))


def chunk_documents(documents: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of ``(document_id string, sections array)``, in a narrow stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for pdf in batches:
            rows = [r for d, s in zip(pdf["document_id"], pdf["sections"], strict=True) for r in chunk_records(d, [] if s is None else list(s), config)]
            yield pd.DataFrame(rows, columns=names)

    return documents.select("document_id", "sections").mapInPandas(run, CHUNK)


def paragraphs_as_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Plain documents as one section each, a paragraph block per line."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    none = F.lit(None)
    blocks = F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text"), none.cast("array<string>").alias("items"), none.cast("array<array<string>>").alias("rows"), none.cast("string").alias("language")))
    key = F.col(id_col).cast("string")
    section = F.struct(F.concat(F.lit("sec_"), F.substring(F.sha1(key.cast("binary")), 1, 16)).alias("section_id"), F.concat_ws(" > ", F.col(path_col), key).alias("section_path"), blocks.alias("blocks"))
    return docs.select(key.alias("document_id"), F.array(section).alias("sections"))
