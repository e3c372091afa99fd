"""Publish functions and table functions to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.functions import text as T

#: SQL function names and their bodies; each is a JVM expression, so SQL keeps code generation.
SQL_FUNCTIONS = {
    "tx_token_count(t STRING) RETURNS BIGINT": f"coalesce(regexp_count(t, r'{T.TOKEN}'), 0)",
    "tx_tokenize(t STRING) RETURNS ARRAY<STRING>": f"transform(regexp_extract_all(coalesce(t, ''), r'{T.TOKEN}', 0), x -> lower(x))",
    "tx_korean_ratio(t STRING) RETURNS DOUBLE": f"coalesce(try_divide(regexp_count(t, r'{T.HANGUL}'), length(regexp_replace(t, r'\\s', ''))), 0.0D)",
    "tx_content_id(t STRING, prefix STRING) RETURNS STRING": "concat(prefix, '_', substring(sha1(t), 1, 16))",
    "tx_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "CASE WHEN size(a) = size(b) THEN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x), "
        "sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x) * aggregate(b, 0.0D, (s, x) -> s + x * x))), 0.0D) ELSE 0.0D END"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions and the ``tx_chunks`` table function; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

    @udtf(returnType="chunk_id string, chunk_index int, token_len int, content string")
    class Chunks:
        """Chunks of one plain text."""

        def eval(self, document_id: str, text: str):
            from millrace.operators.chunk import chunk_records

            blocks = [{"type": "paragraph", "text": line} for line in (text or "").split("\n") if line.strip()]
            for row in chunk_records(document_id, [{"section_id": document_id, "section_path": document_id, "blocks": blocks}]):
                yield row[1], row[2], row[7], row[5]

    spark.udtf.register("tx_chunks", Chunks)
    return [s.split("(")[0] for s in SQL_FUNCTIONS] + ["tx_chunks"]
