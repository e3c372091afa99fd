"""A stored inverted index with the greatest weight of each block, and exact top k that skips blocks by it.

Four tables lie in the index's folder. ``blocks``: documents that are read together are dealt into blocks in the order of their lengths, which
their weights follow; a row holds the documents of one block that have a token, with their counts, the greatest count and the least
length. ``terms``: (token, df, most), and ``stats``: documents and their mean length. All come from one narrow pass over the texts; only the
counts of each task's tokens are shuffled. Weights are made where they are used.
``packs``: documents with their postings as numbers, many in a row, for passes that score every document
(:mod:`millrace.operators.search`); they are made from the texts by themselves, and stored alone.

The weight of the greatest count in the shortest text, summed over a query's tokens, bounds every score in a block. The most promising blocks of each
query are scored first; its k-th score there is a floor, and only blocks whose bound reaches it are read. No
query reads a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import retrieve
from millrace.operators.retrieve import K1, B, exploded, query_tokens
from millrace.sources.stored import durable, stored_once
from millrace.sources.tables import table

#: Documents of a block, and blocks of a query that are scored before any is skipped.
BLOCK_DOCS, FIRST_BLOCKS = 64, 16
#: Documents and postings of a pack at most (a longer document is a pack by itself), and tokens whose numbers a task keeps.
PACK_DOCS, PACK_POSTINGS, KNOWN = 256, 1 << 16, 500_000
PACK_TYPE = "array<struct<doc_id: bigint, dl: bigint, nt: bigint, t: array<bigint>, tf: array<int>, tech: array<boolean>>>"
PACK_ITEM = pa.struct({"doc_id": pa.int64(), "dl": pa.int64(), "nt": pa.int64(), "t": pa.list_(pa.int64()), "tf": pa.list_(pa.int32()), "tech": pa.list_(pa.bool_())})
_SEEN = pa.struct({"t": pa.int64(), "df": pa.int64()})
#: Documents and characters of them that are cut at once at most (a longer document by itself), and bytes of a row group of packs.
PIECE_DOCS, PIECE_CHARS, ROW_GROUP = 4096, 1 << 23, 8 << 20
_TOKEN, _HANGUL = re.compile(T.TOKEN), re.compile(T.HANGUL)
#: ASCII letters to lower ones, what is in no token to a space.
_SPACED = bytes(ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or chr(c) in "_./-") else 32 for c in range(256))
#: Tokens of queries that are sent to every task at most.
FEW_TOKENS = 1 << 19
#: Bounds this much below the floor still count: scores are rounded to 9 digits.
SLACK = 1e-6


@dataclass(frozen=True)
class InvertedIndex:
    """``made`` gives the packs when they are first asked for."""

    blocks: DataFrame | None
    terms: DataFrame | None
    stats: DataFrame | None
    made: Callable[[], DataFrame]

    @property
    def packs(self) -> DataFrame:
        return self.made()

    @property
    def postings(self) -> DataFrame:
        """``(token, doc_id, tf, dl, nt)``: dl tokens and nt technical ones; documents without tokens have none."""
        return self.blocks.select("token", F.inline("held"))


def _weight(tf: Column, dl: Column) -> Column:
    """The BM25 weight of a posting, with ``idf`` and ``avgdl`` beside it."""
    length = 1 - B + B * dl / F.greatest(F.col("avgdl"), F.lit(1e-9))
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * length)


def token_numbers(token: Column) -> list[Column]:
    """What a pass needs of a token: ``t``, the 64 bits that its place and sign in a hash embedding come from, and whether it is technical."""
    high, low = V.hash_halves(token)
    return [(F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high) * (1 << 32) + low).alias("t"), token.rlike("[A-Za-z0-9]").alias("tech")]


class _Numbers(dict):
    """Place of each token among those that a task has seen, and what belongs to each place: the number ``t``, whether it is technical, and in how many documents it was."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.t, self.tech, self.df, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool), np.zeros(1 << 12, np.int64), 0
        self.docs = self.length = 0

    def __missing__(self, token: str) -> int:
        place = self[token] = len(self)
        self.new.append(token)
        return place

    def places(self, words: Collection[str]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            end = self.used + len(self.new)
            while end > len(self.t):
                self.t, self.tech, self.df = (np.concatenate([a, np.zeros_like(a)]) for a in (self.t, self.tech, self.df))
            self.t[self.used : end] = np.frombuffer(b"".join([hashlib.sha1(w.encode()).digest()[:8] for w in self.new]), ">i8")
            self.tech[self.used : end] = [_technical(w) for w in self.new]
            self.used, self.new = end, []
        return found

    def seen(self) -> pa.RecordBatch:
        """One row with what the task has counted: its documents, their tokens, and the documents of each token."""
        had = np.flatnonzero(self.df[: self.used])
        pairs = pa.StructArray.from_arrays([pa.array(self.t[had]), pa.array(self.df[had])], names=["t", "df"])
        held = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(PACK_ITEM)), held, pa.array([self.docs]), pa.array([self.length])], names=["items", "seen", "docs", "length"])


def _spaced(text: str) -> bytes:
    """Lower-case tokens of a text, with spaces between them. Letters that only become ASCII ones by lower-casing are none."""
    if text.isascii() or not _HANGUL.search(text):
        return text.encode("ascii", "replace").translate(_SPACED)
    return " ".join(_TOKEN.findall(text)).lower().encode()


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Batches ``(id, texts)`` as ``(ids, place among them of each text, spaced tokens of each text)``, at most ``PIECE_DOCS`` ids and about ``PIECE_CHARS`` characters at once."""
    ids, place, texts, size = [], [], [], 0
    for batch in batches:
        for row_id, own in zip(batch.column(0), batch.column(1), strict=True):
            for text in own.as_py():
                if text is not None:
                    place.append(len(ids))
                    texts.append(_spaced(text))
                    size += len(texts[-1])
            ids.append(row_id.as_py())
            if len(ids) >= PIECE_DOCS or size >= PIECE_CHARS:
                yield ids, place, texts
                ids, place, texts, size = [], [], [], 0
    if ids:
        yield ids, place, texts


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text and the place among the words of each token, and the words."""
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = cut.flatten().dictionary_encode()
    words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())
    if "" in words:  # before a first space and behind a last one
        real = code != words.index("")
        text, code = text[real], code[real]
    return text, code, words


def _technical(word: str) -> bool:
    return word[:1] < "\x80" and word.strip("_./-") != ""


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``(id, texts)`` to packs of at most ``PACK_DOCS`` documents and about ``PACK_POSTINGS`` postings, and rows of what was counted. Rows of one id add up; the longest gives the length.

    Arrow cuts and numbers the words of many texts at once, so that Python looks up each word once for all of them.
    """
    known = _Numbers()
    for ids, place, texts in _in_pieces(batches):
        if len(known) > KNOWN:
            yield known.seen()
            known = _Numbers()
        text, code, words = _cut(texts)
        number = known.places(words)
        wide, owner = max(1, len(words)), np.array(place, np.int64)
        key, tf = np.unique(text * wide + code, return_counts=True)
        dl, nt = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.maximum.at(dl, owner, np.bincount(text, minlength=len(texts)))
        np.maximum.at(nt, owner, np.bincount(key // wide, known.tech[number[key % wide]], len(texts)).astype(np.int64))
        key = owner[key // wide] * wide + key % wide
        if len(set(place)) < len(place):
            key, at = np.unique(key, return_inverse=True)
            tf = np.bincount(at, tf, len(key))
        doc, own = key // wide, number[key % wide]
        np.add.at(known.df, own, 1)
        known.docs, known.length = known.docs + len(ids), known.length + int(dl.sum())
        ends = np.searchsorted(doc, np.arange(len(ids)), "right")
        first = at = 0
        while first < len(ids):
            last = min(len(ids), first + PACK_DOCS, 1 + int(np.searchsorted(ends, at + PACK_POSTINGS)))
            starts = pa.array(np.concatenate([[at], ends[first:last]]) - at, pa.int32())
            mine = own[at : ends[last - 1]]
            lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (known.t[mine], tf[at : ends[last - 1]].astype(np.int32), known.tech[mine])]
            items = pa.StructArray.from_arrays([*(pa.array(x[first:last], pa.int64()) for x in (ids, dl, nt)), *lists], fields=list(PACK_ITEM))
            pack = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), items)
            yield pa.RecordBatch.from_arrays([pack, pa.nulls(1, pa.list_(_SEEN)), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["items", "seen", "docs", "length"])
            first, at = last, int(ends[last - 1])
    yield known.seen()


def _texts_by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, texts)``: texts are shuffled only for ids that several rows have."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id"))
    once = rows.select("id", F.array("text").alias("texts"))
    if again.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("_id"))
        several = rows.join(again, same, "left_semi").groupBy("id").agg(F.collect_list("text").alias("texts"))
        once = once.join(again, same, "left_anti").unionByName(several)
    return once


def write_packs(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the packs of ``docs``: its texts are read in one narrow pass, and only ids and the counts of each task's tokens are shuffled.

    Three kinds of rows: ``docs`` (items), ``terms`` (t and its document frequency), ``all`` (one row: documents and their
    mean length). Weights are made where they are used, from the frequencies of a query's tokens. What a task counted lies
    beside its packs. Row groups are small: a reader holds one of them at a time, with all its packs.
    """
    spark = docs.sparkSession
    once = _texts_by_id(docs, id_col, text_col)
    counted = "seen array<struct<t: bigint, df: bigint>>, docs bigint, length bigint"
    small = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}
    once.mapInArrow(_numbered, f"items {PACK_TYPE}, {counted}").write.options(**small).parquet(f"{folder}/kind=docs")
    made = spark.read.schema(counted).parquet(f"{folder}/kind=docs")
    made.select(F.inline("seen")).groupBy("t").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/kind=terms")
    n_docs = F.coalesce(F.sum("docs"), F.lit(0))
    made.agg(n_docs.alias("n_docs"), (F.sum("length") / F.greatest(n_docs, F.lit(1))).alias("avgdl")).write.parquet(f"{folder}/kind=all")


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"items {PACK_TYPE}, t long, df long, n_docs long, avgdl double, kind string").parquet(folder)


def packs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The stored packs of a table's texts, made the first time that they are asked for; no postings are written for them."""
    return read_packs(spark, stored_once(spark, f"packs-{name}", [f"{sf_dir}/{name}.parquet"], lambda folder: write_packs(table(spark, sf_dir, name), folder)))


def _blocked(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches ``(id, texts)`` to rows of blocks. What is read together is sorted by length; its last row has the numbers of documents and of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for ids, place, texts in _in_pieces(batches):
            text, code, words = _cut(texts)
            wide, owner = max(1, len(words)), np.array(place, np.int64)
            key, tf = np.unique(text * wide + code, return_counts=True)
            tech = np.array([_technical(w) for w in words] or [False])
            dl, nt = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.maximum.at(dl, owner, np.bincount(text, minlength=len(texts)))
            np.maximum.at(nt, owner, np.bincount(key // wide, tech[key % wide], len(texts)).astype(np.int64))
            key, at = np.unique(owner[key // wide] * wide + key % wide, return_inverse=True)  # rows of one id add up
            tf = np.bincount(at, tf, len(key)).astype(np.int64)
            block = np.empty(len(ids), np.int64)
            block[np.lexsort((np.arange(len(ids)), dl))] = np.arange(len(ids)) // block_docs
            doc, word = key // wide, key % wide
            order = np.lexsort((doc, block[doc], word))
            doc, word, tf = doc[order], word[order], tf[order]
            group = word * (len(ids) + 1) + block[doc]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            columns = [pa.array(x, pa.int64()) for x in (pa.array(ids, pa.int64()).take(pa.array(doc)), tf, dl[doc], nt[doc])]
            items = pa.StructArray.from_arrays(columns, names=["doc_id", "tf", "dl", "nt"])
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), items)
            most, least = (f.reduceat(x, first) if len(first) else first for f, x in ((np.maximum, tf), (np.minimum, dl[doc])))
            tokens = pa.array(words, pa.string()).take(pa.array(word[first]))
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([tokens, pa.array(made + block[doc[first]]), held, pa.array(most), pa.array(least), none, none], names=list(_BLOCK))
            made += len(ids) // block_docs + 1
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.string(), pa.int64(), held.type, pa.int64(), pa.int64())] + [pa.array([len(ids)]), pa.array([int(dl.sum())])], names=list(_BLOCK))

    return run


_BLOCK = {"token": "string", "block": "bigint", "held": "array<struct<doc_id: bigint, tf: bigint, dl: bigint, nt: bigint>>", "most": "bigint", "least": "bigint", "docs": "bigint", "length": "bigint"}


def write_blocks(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> None:
    """Write ``blocks``, ``terms`` and ``stats`` of ``docs``. A token of all documents has one row for each block, so no row holds more than a block's documents.
    Null texts have no tokens; rows of one id are one document."""
    spark = docs.sparkSession
    small = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}
    _texts_by_id(docs, id_col, text_col).mapInArrow(_blocked(block_docs), ", ".join(f"{k} {v}" for k, v in _BLOCK.items())).write.options(**small).parquet(f"{folder}/blocks")
    made = spark.read.parquet(f"{folder}/blocks")
    counted = made.where("token IS NOT NULL").select("token", "most", F.size("held").cast("long").alias("n"))
    counted.groupBy("token").agg(F.sum("n").alias("df"), F.max("most").alias("most")).write.parquet(f"{folder}/terms")
    n_docs = F.coalesce(F.sum("docs"), F.lit(0))
    made.agg(n_docs.alias("n_docs"), (F.sum("length") / F.greatest(n_docs, F.lit(1))).alias("avgdl")).write.parquet(f"{folder}/stats")


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> None:
    """Write the index of ``docs`` with its packs into ``folder``: texts are read once for each, and not shuffled."""
    write_blocks(docs, folder, id_col, text_col, block_docs)
    write_packs(docs, f"{folder}/packs", id_col, text_col)


def open_index(spark: SparkSession, folder: str, made: Callable[[], DataFrame] | None = None) -> InvertedIndex:
    blocks, terms, stats = (spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "terms", "stats"))
    return InvertedIndex(blocks.where("token IS NOT NULL").drop("docs", "length"), terms, stats, made or (lambda: read_packs(spark, f"{folder}/packs")))


def index_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> InvertedIndex:
    """The stored index of a table's texts, built the first time that it is asked for; its packs are stored alone."""
    folder = stored_once(spark, f"inverted-{name}", [f"{sf_dir}/{name}.parquet"], lambda folder: write_blocks(table(spark, sf_dir, name), folder))
    return open_index(spark, folder, lambda: packs_of(spark, sf_dir, name))


def _rated(index: InvertedIndex, queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """``(query_id, token, idf, avgdl)`` of the queries' tokens, and the tokens alone; few of them are sent to where the blocks are read."""
    asked = durable(query_tokens(queries, query_id, query_text))
    few = asked.count() <= FEW_TOKENS
    words = asked.select("token").distinct()
    terms = index.terms.join(F.broadcast(words) if few else words, "token", "left_semi").crossJoin(F.broadcast(index.stats))  # the statistics are one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = durable(asked.join(terms.select("token", idf.alias("idf"), "avgdl"), "token").select("query_id", "token", "idf", "avgdl"))
    words = rated.select("token").distinct()
    return (F.broadcast(rated), F.broadcast(words)) if few else (rated, words)


def _scored(index: InvertedIndex, rated: DataFrame, words: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(query_id, doc_id, bm25)`` of all documents in the chosen blocks ``(query_id, block)`` that share a token with the query.

    The rows of a block meet before they are spread, so that its documents are added up where they are.
    """
    wanted = chosen.groupBy("block").agg(F.collect_set("query_id").alias("asking"))
    held = index.blocks.select("token", "block", "held").join(words, "token", "left_semi").repartition("block").join(wanted, "block")
    rows = held.join(rated, "token").where(F.array_contains("asking", F.col("query_id"))).select("block", "query_id", "idf", "avgdl", F.explode("held").alias("x"))
    weighed = rows.select("block", "query_id", F.col("x.doc_id").alias("doc_id"), _weight(F.col("x.tf"), F.col("x.dl")).alias("w"))
    return weighed.groupBy("block", "query_id", "doc_id").agg(F.sum("w").alias("bm25")).select("query_id", "doc_id", "bm25")


def _bounded(index: InvertedIndex, queries: DataFrame, k: int, query_id: str, query_text: str, first: int) -> tuple[tuple[DataFrame, DataFrame], DataFrame, DataFrame]:
    """What is known of the queries' tokens, the scores of each query's first blocks, and ``(query_id, block, skipped)`` of the others."""
    rated = _rated(index, queries, query_id, query_text)
    tops = index.blocks.select("token", "block", "most", "least").join(rated[0], "token").select("query_id", "block", _weight(F.col("most"), F.col("least")).alias("top"))
    bounds = tops.groupBy("query_id", "block").agg(F.sum("top").alias("bound"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    ranked = durable(bounds.withColumn("place", place))  # a row for each query and block
    early = durable(_scored(index, *rated, ranked.where(F.col("place") <= first)))
    floor = retrieve.top_k(early, "bm25", k).where(F.col("rank") == k).select("query_id", F.col("bm25").alias("floor"))
    skipped = F.coalesce(F.col("bound") < F.col("floor") - SLACK, F.lit(False))
    return rated, early, ranked.where(F.col("place") > first).join(floor, "query_id", "left").select("query_id", "block", skipped.alias("skipped"))


def bm25_top_k(index: InvertedIndex, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", first: int = FIRST_BLOCKS, digits: int = 9) -> DataFrame:
    """``(query_id, doc_id, bm25, rank)``: the k best documents of each query, ties by id; exactly those of scoring every document."""
    rated, early, late = _bounded(index, queries, k, query_id, query_text, first)
    found = early.union(_scored(index, *rated, late.where("NOT skipped"))).withColumn("bm25", F.round("bm25", digits))
    return retrieve.top_k(found, "bm25", k)


def blocks_skipped(index: InvertedIndex, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", first: int = FIRST_BLOCKS) -> DataFrame:
    """``(query_id, blocks, skipped)``: blocks behind the first ones that hold a token of the query, and those that aren't read."""
    late = _bounded(index, queries, k, query_id, query_text, first)[2]
    return late.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("skipped").alias("skipped"))


def bm25(index: InvertedIndex, queries: DataFrame, query_id: str = "item_id", query_text: str = "text", digits: int = 9) -> DataFrame:
    """``(query_id, doc_id, bm25)`` of every document that shares a token with the query: one join on tokens, one combine."""
    rated, _ = _rated(index, queries, query_id, query_text)
    held = index.blocks.select("token", "held").join(rated, "token").select("query_id", "idf", "avgdl", F.explode("held").alias("x"))
    weighed = held.select("query_id", F.col("x.doc_id").alias("doc_id"), _weight(F.col("x.tf"), F.col("x.dl")).alias("w"))
    return weighed.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), digits).alias("bm25"))


def technical_overlap(index: InvertedIndex, queries: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``(query_id, doc_id, technical)`` as :func:`millrace.operators.retrieve.technical_overlap` gives it, from the postings."""
    terms = T.technical_tokens(T.tokens(F.col(query_text)))
    wanted = queries.select(F.col(query_id).alias("query_id"), terms.alias("q")).select("query_id", F.size("q").alias("nq"), exploded(F.col("q")).alias("token")).where("token IS NOT NULL")
    shared = index.postings.select("doc_id", "token", "nt").join(wanted, "token").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("nq").alias("nq"), F.first("nt").alias("nt"))
    return shared.select("query_id", "doc_id", (F.col("n") / F.sqrt(F.col("nq") * F.col("nt"))).alias("technical"))


def matching(index: InvertedIndex, tokens: Column | list[str]) -> DataFrame:
    """Postings of given tokens; a list of them reaches the scan as a filter."""
    return index.postings.where(F.col("token").isin(tokens) if isinstance(tokens, list) else tokens)
