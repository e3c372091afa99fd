"""Fill-in-middle transformation over token offsets of the tokenizers library's Split pre-tokenizer.

The pre-tokenizer isolates the matches of one pattern that covers every text, so nothing is trained
and its offsets are code points of the text itself. Their number is n; two draws between 0 and n,
hashed from seed and id, are ranked, and the offsets at these ranks cut prefix, middle and suffix::

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text itself

Only the text goes to Python, and three numbers come back; the slices are put together in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Tuple  # noqa: UP035  (Spark reads this hint)

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, tidy

SPACE = r"\x20\x09-\x0D"
#: White space belongs to the word after it; what is left at the end is a token of its own.
TOKEN = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: Control strings; a text that holds one stays plain, so the first of each in an output is ours.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain; of 100 others so many are spm.
PLAIN_OF_100, SPM_OF_100 = 50, 80
#: Code points that are cut into tokens at a time: the library returns an object for each token.
BLOCK = 1 << 18
CUT = "struct<n: bigint, prefix: bigint, middle: bigint>"


def token_ends(block: int = BLOCK) -> Callable[[str], np.ndarray]:
    """``ends(text)``: where each token ends, in code points; an empty text has none.

    A long text goes through the pre-tokenizer in blocks that end where a word does, which is always the
    end of a token.
    """
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(TOKEN), behavior="isolated")
    word_end = re.compile(rf"[^{SPACE}](?=[{SPACE}])")

    def ends(text: str) -> np.ndarray:
        found, at = [np.zeros(0, np.int64)], 0
        while at < len(text):
            cut = word_end.search(text, at + block) if len(text) - at > block else None
            stop = cut.end() if cut else len(text)
            found.append(np.array([e for _, (_, e) in split.pre_tokenize_str(text[at:stop])], np.int64) + at)
            at = stop
        return np.concatenate(found)

    return ends


def _cut(batches: Iterator[Tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:  # noqa: UP006
    """Number of tokens, and code points of prefix and middle, of texts and their two draws."""
    ends = token_ends()
    try:
        for texts, first, second in batches:
            out = np.zeros((3, len(texts)), np.int64)
            for i, (text, a, b) in enumerate(zip(texts, first.to_pylist(), second.to_pylist(), strict=True)):
                offsets = np.concatenate([[0], ends(text.as_py())])
                n = len(offsets) - 1
                low, high = sorted((a % (n + 1), b % (n + 1)))
                out[:, i] = n, offsets[low], offsets[high] - offsets[low]
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "prefix", "middle"])
    finally:
        tidy()


def draw(seed: int, id_col: Column, k: int) -> Column:
    """The k-th unsigned 32-bit number (from 1) of the SHA-256 of seed and id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: id, ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The two lengths are code points, null where the form is plain. A null text is an empty one and, like
    every empty text and every text that holds a control string, plain; a text of white space alone is one
    token. Rows repeated under one id are cut alike; a null id draws like an empty one; an empty table gives
    an empty one; other columns are not read, whatever their names. The stage is narrow, and a text is held
    whole by one task.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_f_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_f_text"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("_f_text"), F.lit(mark))
    plain = (F.col("_f_text") == "") | marked | (draw(seed, F.col("_f_id"), 3) % 100 >= PLAIN_OF_100)
    form = F.when(plain, "plain").when(draw(seed, F.col("_f_id"), 4) % 100 < SPM_OF_100, "spm").otherwise("psm")
    cut = rows.select("*", form.alias("_f_form"), F.arrow_udf(_cut, CUT)("_f_text", draw(seed, F.col("_f_id"), 1), draw(seed, F.col("_f_id"), 2)).alias("_f_cut"))
    text, prefix, middle = F.col("_f_text"), F.col("_f_cut.prefix").cast("int"), F.col("_f_cut.middle").cast("int")
    head, body, tail = F.substr(text, F.lit(1), prefix), F.substr(text, prefix + 1, middle), F.substr(text, prefix + middle + 1)
    first = F.when(F.col("_f_form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail)).otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head))
    shown = F.col("_f_form") != "plain"
    return cut.select(
        F.col("_f_id").alias(id_col),
        F.col("_f_cut.n").alias("n"),
        F.col("_f_form").alias("form"),
        F.when(shown, F.col("_f_cut.prefix")).alias("prefix_chars"),
        F.when(shown, F.col("_f_cut.middle")).alias("middle_chars"),
        F.when(shown, F.concat(first, F.lit(MIDDLE), body)).otherwise(text).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = F.when(form == "plain", output)
    for name, places in order.items():
        joined = joined.when(form == name, F.concat(*(F.get(parts, F.lit(i)) for i in places)))
    return joined


def fim_digest(transformed: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts rebuilt from them, for the rows of :func:`fill_in_middle`."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    kept = [c for c in transformed.columns if c != "output"]
    return transformed.select(*kept, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
