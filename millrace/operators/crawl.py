"""A crawl over stored pages: breadth first, each address once, each content and each document once.

Every step is a join of the frontier with the pages, and is kept in the shared folder, so a lost executor costs
one step. The order of a sequential crawl is kept without numbering anything globally: an address is
ordered by its depth and by the places of the links on the way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.stored import durable

STATES = ("kept", "duplicate_content", "duplicate_document", "missing")


def _first_come(fetched: DataFrame, hashes: DataFrame, documents: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of one step's pages those that a crawl in their order keeps, with the hashes and documents seen so far.

    A page goes if its content, or else its document, was kept before it. Pages first in both are kept,
    those that share with them go, and so on with what is left; each round settles at least the first page.
    """
    left = durable(fetched.join(hashes, "content_hash", "left_anti").join(documents, "document_id", "left_anti"))
    kept = []
    for _ in range(rounds):
        by_hash = left.groupBy("content_hash").agg(F.min("way").alias("_h"))
        by_document = left.groupBy("document_id").agg(F.min("way").alias("_d"))
        first = durable(left.join(by_hash, "content_hash").join(by_document, "document_id").where("way = _h AND way = _d").drop("_h", "_d"))
        if first.isEmpty():
            break
        kept.append(first)
        left = durable(left.join(first.select("content_hash"), "content_hash", "left_anti").join(first.select("document_id"), "document_id", "left_anti"))
    every = reduce(DataFrame.unionByName, kept) if kept else left.where("false")
    return every, durable(hashes.union(every.select("content_hash"))), durable(documents.union(every.select("document_id")))


def crawl(pages: DataFrame, links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(url, depth, parent, state)`` of every address that is reached in at most ``depth`` steps.

    ``pages(url, content_hash, document_id)``, ``links(source, place, target)`` in the order of a page,
    ``starts(url, place)``. Links of duplicate pages are followed too; a missing page has none. Rows of
    one address in ``pages`` are one page (that of the least content hash); ties of place are settled by address.
    """
    known = pages.groupBy("url").agg(F.min(F.struct("content_hash", "document_id")).alias("p")).select("url", "p.*")
    edges = links.groupBy("source", "target").agg(F.min("place").cast("long").alias("place")).where("target IS NOT NULL")
    step = starts.groupBy("url").agg(F.min("place").cast("long").alias("place")).select("url", F.lit(None).cast("string").alias("parent"), F.array(F.struct("place", F.col("url").alias("at"))).alias("way"))
    seen = hashes = documents = None
    done = []
    for level in range(depth + 1):
        step = durable(step)
        if step.isEmpty():
            break
        fetched = durable(step.join(known, "url"))
        if hashes is None:
            hashes, documents = fetched.select("content_hash").where("false"), fetched.select("document_id").where("false")
        before_hash = hashes.distinct()
        kept, hashes, documents = _first_come(fetched, hashes, documents)
        # a page that is not kept: its content was kept earlier in the crawl's order, else its document
        own = kept.select("content_hash", F.col("way").alias("_w"))
        earlier = fetched.join(kept.select("url"), "url", "left_anti").join(before_hash.withColumn("_b", F.lit(True)), "content_hash", "left").join(own, "content_hash", "left")
        lost = earlier.select("url", F.when(F.coalesce("_b", F.lit(False)) | F.coalesce(F.col("_w") < F.col("way"), F.lit(False)), "duplicate_content").otherwise("duplicate_document").alias("state"))
        missing = step.join(known.select("url"), "url", "left_anti").select("url", F.lit("missing").alias("state"))
        states = kept.select("url", F.lit("kept").alias("state")).union(lost).union(missing)
        done.append(durable(step.join(states, "url").select("url", F.lit(level).alias("depth"), "parent", "state")))
        seen = step.select("url") if seen is None else durable(seen.union(step.select("url")))
        found = fetched.select(F.col("url").alias("source"), "way").join(edges, "source").select(F.col("target").alias("url"), F.col("source").alias("parent"), F.concat("way", F.array(F.struct("place", F.col("target").alias("at")))).alias("way"))
        step = found.join(seen, "url", "left_anti").groupBy("url").agg(F.min(F.struct("way", "parent")).alias("x")).select("url", "x.parent", "x.way")
    return reduce(DataFrame.unionByName, done) if done else step.select("url", F.lit(0).alias("depth"), "parent", F.lit("missing").alias("state"))
