"""File sources and sinks: JSON lines, CSV with the union of columns, report text."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window


def without_nul(column: Column, kind) -> Column:
    """NUL characters removed from every string inside a column."""
    if isinstance(kind, StringType):
        return F.translate(column, "\x00", "")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, StructType, ArrayType)):
        return F.transform(column, lambda x: without_nul(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*(without_nul(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return column


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, NULs removed."""
    raw = spark.read.schema(schema).json(path)
    return raw.select(*(without_nul(F.col(f.name), f.dataType).alias(f.name) for f in raw.schema.fields))


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def first_groups(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """All rows of the n groups that begin first by ``order`` (a limit that is the feature)."""
    chosen = df.groupBy(group).agg(F.min(order).alias("_o")).orderBy("_o", group).limit(n).select(group)
    return df.join(F.broadcast(chosen), group, "left_semi") if n <= 100_000 else df.join(chosen, group, "left_semi")


def union_columns(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(path: str, *frames: DataFrame) -> None:
    """One CSV folder with the union of the frames' columns in its header."""
    union_columns(*frames).write.mode("overwrite").option("header", True).csv(path)


def bar(share: Column, width: int = 20) -> Column:
    """A text bar of a share in 0..1."""
    full = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("·"), width - full))


def markdown_table(df: DataFrame, rows: int = 200) -> str:
    """A Markdown table of at most ``rows`` rows, for reports."""
    found = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])


def merged(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """Nested dictionaries merged, the override first."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def config_hash(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def distribution(weights: dict[str, float], default: dict[str, float]) -> dict[str, float]:
    """Weights without negatives, summing to 1; the default if nothing is left."""
    positive = {k: max(0.0, float(v)) for k, v in weights.items()}
    total = sum(positive.values())
    return {k: v / total for k, v in positive.items()} if total > 0 else dict(default)


def enabled_sources(loaded: Any) -> list[dict[str, Any]]:
    """Source rows of a configuration: a list, a mapping with ``sources``, or one row; those not switched off."""
    rows = loaded.get("sources", [loaded]) if isinstance(loaded, dict) else loaded or []
    on = lambda v: str(v).strip().lower() not in ("false", "0", "no", "off")
    return [r for r in rows if isinstance(r, dict) and r and on(r.get("enabled", True))]


def read_config(path: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """A JSON file, or YAML where the library for it is installed, over defaults."""
    with open(path, encoding="utf-8") as f:  # a small file of the driver's
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        loaded = yaml.safe_load(text)
    else:
        loaded = json.loads(text)
    return merged(defaults or {}, loaded or {})
