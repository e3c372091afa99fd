"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 letters, words padded with a blank) in
order of frequency. A document's own list is compared with each language's: every n-gram adds how far
its place is out of the place in the language's list, or the full length if it is not there. The
language with the least sum is the prediction.

n-grams are exact: three code points fit into one 64-bit key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import durable, map_rows

UNKNOWN = "und"
#: Length of a profile.
PLACES = 400
#: Bound of what is learned from: documents of each language. Languages up to which their rates are broadcast.
PER_LANGUAGE, LANGUAGES = 400, 10_000
BLOCK = 1 << 20

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of the whole text, ascending, with their counts; long texts in blocks."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and end < at + 2 * BLOCK and text[end].isalpha():  # blocks end between words
            end += 1
        k, n = _block_counts(text[at:end])
        if at:
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        else:
            keys, counts = k, n
        at = end
    return keys, counts


def _block_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(letters()[points], points, 32).astype(np.uint64)
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word
    keep[0] = True
    points, s = points[keep], np.uint64(21)
    blank = points == 32
    one = points[~blank]
    two = (points[:-1] << s | points[1:])[~(blank[:-1] & blank[1:])]
    three = ((points[:-2] << s | points[1:-1]) << s | points[2:])[~blank[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top_places(keys: np.ndarray, counts: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The most frequent keys in order; equal counts by key."""
    return keys[np.argsort(-counts, kind="stable")[:places]]


class Profiles:
    """The learned lists, as one table of places by n-gram and language."""

    def __init__(self, lists: dict[str, np.ndarray], places: int = PLACES) -> None:
        self.languages = sorted(lists)
        self.places = places
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists.values()]))
        self.table = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int64)
        for j, name in enumerate(self.languages):
            self.table[np.searchsorted(self.keys, lists[name]), j] = np.arange(len(lists[name]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place sums by language, as parts of the greatest possible."""
        at = np.searchsorted(self.keys, top)
        known = np.append(self.keys, np.uint64(0))[at] == top
        rank = np.where(known[:, None], self.table[at], -1)
        out = np.where(rank < 0, self.places, np.abs(rank - np.arange(len(top))[:, None]))
        return out.sum(axis=0) / (self.places * len(top))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score (1 - distance); "und" and 0 without letters or without any profile."""
        keys, counts = ngram_counts(text or "")
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        d = self.distances(top_places(keys, counts, self.places))
        best = int(d.argmin())
        return self.languages[best], float(max(0.0, 1 - d[best]))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, places: int = PLACES) -> Profiles:
    """Profiles from about ``per_language`` documents of each language, however many languages there are.

    Documents are drawn by the hash of id and text at a rate set from the counts of all rows, so a draw
    covers the whole table. Executors count the n-grams of whole texts, merged by batch and then by
    language; the driver gets the ``places`` most frequent of each language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("_t"), F.col(id_col).alias("_i"))
    rates = durable(rows.groupBy("_l").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("rate")))
    few = rates.limit(LANGUAGES + 1).count() <= LANGUAGES
    draw = F.pmod(F.xxhash64(F.lit("langid"), "_i", "_t"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.join(F.broadcast(rates) if few else rates, "_l").where(draw < F.col("rate"))

    def make():
        def work(lang, text):
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for name, t in zip(lang.to_pylist(), text.to_pylist(), strict=True):
                parts.setdefault(name, []).append(ngram_counts(t))
            merged = {name: merged_counts(p) for name, p in parts.items()}
            return [list(merged), [k.view(np.int64) for k, _ in merged.values()], [n for _, n in merged.values()]]

        return work

    counted = map_rows(drawn, "l string, k array<bigint>, n array<bigint>", make, ["_l", "_t"])
    flat = counted.select("l", F.inline(F.arrays_zip("k", "n"))).groupBy("l", "k").agg(F.sum("n").alias("n"))
    top = flat.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "k"))).where(F.col("place") <= places)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("l", "place", "k").toLocalIterator():
        lists.setdefault(r["l"], []).append((r["place"], r["k"]))
    return Profiles({name: np.array([k for _, k in sorted(found)], np.int64).view(np.uint64) for name, found in lists.items()}, places)


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of several counts with their sums."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row, in one narrow stage that reads id and text only.

    "und" with score 0 if the text is null or has no letter; ties go to the first language by name;
    whole texts count, long ones block by block; repeated rows each give a row; an empty table gives
    an empty one.
    """

    def make():
        def work(row_id, text):
            found = [profiles.predict(t) for t in text.to_pylist()]
            return [row_id, [f[0] for f in found], [f[1] for f in found]]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, f"`{id_col}` {kind}, lang_pred string, score double", make, [id_col, text_col])
