"""Evaluation datasets: query planning, family splits, summaries, document import decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T


def hashed_unit(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and parts."""
    raw = F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(raw.cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The option whose share of the cumulated weights holds ``u``."""
    total, passed, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        passed += w / total
        out = F.when(u < passed, name) if out is None else out.when(u < passed, name)
    return out.otherwise(list(weights)[-1])


def plan_queries(chunks: DataFrame, average: float, types: dict[str, float], answerability: dict[str, float], seed: str = "plan", id_col: str = "chunk_id") -> DataFrame:
    """Planned queries of each chunk: about ``average`` of them, each with a drawn type and answerability."""
    number = F.greatest(F.lit(0), F.round(F.lit(average) + (hashed_unit(seed, F.col(id_col)) * 1.8 - 0.9)).cast("int"))
    spread = chunks.select(F.col(id_col), number.alias("n")).where("n > 0").select(id_col, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq"))
    draw = lambda kind: hashed_unit(f"{seed}:{kind}", F.col(id_col), F.col("seq"))
    return spread.select(id_col, "seq", weighted_choice(draw("type"), types).alias("query_type"), weighted_choice(draw("answer"), answerability).alias("answerability"))


def query_text(strategy: Column, reply: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """The text of a model's JSON reply: the first filled field of the strategy's list."""
    out = F.lit(None).cast("string")
    for name, keys in fields.items():
        out = F.when(strategy == name, F.coalesce(*(F.nullif(F.trim(F.get_json_object(reply, f"$.{k}")), F.lit("")) for k in keys))).otherwise(out)
    return out


def family(url: Column, document_id: Column | None = None) -> Column:
    """Host and first path part (the host alone where there is none): pages that belong together. Without a URL, the first part of the document's id."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    part = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?/*([^/?#]*)", 1)
    source = F.lit(None).cast("string") if document_id is None else F.split_part(document_id, F.lit("::"), F.lit(1))
    by_url = F.when(part != "", F.concat(host, F.lit("/"), part)).otherwise(F.coalesce(F.nullif(host, F.lit("")), source))
    return F.when(F.coalesce(url, F.lit("")) == "", source).otherwise(by_url)


#: Words that make a query one of troubleshooting, part of the results' definition.
TROUBLE = ("오류", "에러", "exception", "failed", "fail")


def category(query_type: Column, text: Column) -> Column:
    """Category of a query: some types are their own, then trouble words decide."""
    low = F.lower(text)
    trouble = F.lit(False)
    for t in TROUBLE:
        trouble = trouble | low.contains(t)
    return F.when(query_type.isin("short_user", "code_mixed", "follow_up"), query_type).when(trouble, "troubleshooting").otherwise("general_ko")


def split_families(samples: DataFrame, share: float = 0.5, seed: str = "split") -> DataFrame:
    """dev and test with no family in both: a family goes where its hash says."""
    return samples.withColumn("split", F.when(hashed_unit(seed, F.col("family")) < share, "dev").otherwise("test"))


#: Endings that make a query one of a category, part of the results' definition: (category, ending, type); the last holds for all others.
FILLERS = (
    ("troubleshooting", " 실행 시 오류가 나는 경우 점검 포인트를 알려주세요.", "reason"), ("short_user", " 빠르게?", "short_user"), ("code_mixed", " 설정할 때 default property가 뭐야?", "code_mixed"),
    ("follow_up", " 그다음에는 뭘 하면 돼?", "follow_up"), ("", " 실무 예시까지 포함해서 설명해 주세요.", "procedure"),
)


def filled_query(category_col: Column, text: Column) -> Column:
    """Struct ``(query_text, query_type)`` of a query made for a category from that of another."""
    short = F.trim(F.split_part(text, F.lit("?"), F.lit(1)))
    made = lambda name, ending, kind: F.struct(F.concat(short if name == "short_user" else text, F.lit(ending)).alias("query_text"), F.lit(kind).alias("query_type"))
    out = made(*FILLERS[-1])
    for name, ending, kind in FILLERS[:-1]:
        out = F.when(category_col == name, made(name, ending, kind)).otherwise(out)
    return out


def build_dataset(candidates: DataFrame, targets: dict[str, dict[str, int]], limit: int = 800, seed: str = "dataset") -> DataFrame:
    """``(split, category, place, id, query_text, query_type, made)``: an evaluation set with quotas by category and no family in two splits.

    ``candidates(id, created_at, query_text, query_type, family, category)``: the newest ``limit`` (a sampling
    operator) are dealt by family, half of the families in seeded order to the first split; one family
    alone serves both. A category takes its quota in seeded order; what is missing is made from its own
    rows in turn, else from those of the split, else from all. Work after the limit is on ``limit`` rows.
    """
    spark = candidates.sparkSession
    first, second = targets
    newest = candidates.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("new", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")) - 1)
    names = newest.select("family").distinct().select("family", F.row_number().over(Window.orderBy(hashed_unit(seed, F.col("family")), "family")).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))
    dealt = names.select("family", F.explode(F.when(F.col("n") == 1, F.array(F.lit(first), F.lit(second))).when(F.col("at") <= F.floor(F.col("n") / 2), F.array(F.lit(first))).otherwise(F.array(F.lit(second)))).alias("split"))
    own = newest.join(dealt, "family")
    order = Window.partitionBy("split", "category").orderBy(hashed_unit(seed, F.col("split"), F.col("id")), "id")
    own = own.select("split", "category", "id", "query_text", "query_type", "new", (F.row_number().over(order) - 1).alias("k"))
    own = own.withColumn("in_split", F.row_number().over(Window.partitionBy("split").orderBy("new")) - 1)
    wanted = spark.createDataFrame([(s, c, n) for s, cs in targets.items() for c, n in cs.items()], "split string, category string, want int")
    sizes = own.groupBy("split", "category").agg(F.count(F.lit(1)).cast("int").alias("have"))
    splits = own.groupBy("split").agg(F.count(F.lit(1)).cast("int").alias("n_split"))
    asked = wanted.join(sizes, ["split", "category"], "left").join(splits, "split", "left").crossJoin(F.broadcast(newest.agg(F.count(F.lit(1)).cast("int").alias("n_all")))).na.fill(0, ["have", "n_split"])
    taken = own.join(asked.select("split", "category", "want"), ["split", "category"]).where("k < want").select("split", "category", F.col("k").alias("place"), "id", "query_text", "query_type", F.lit(False).alias("made"))
    short = asked.where("have < want AND n_all > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("want") - F.col("have") - 1)).alias("i")).withColumn("place", F.col("have") + F.col("i"))
    slim = lambda df, *keys: df.select(*keys, "id", "query_text")
    by_category = short.where("have > 0").withColumn("k", F.col("i") % F.col("have")).join(slim(own, "split", "category", "k"), ["split", "category", "k"])
    by_split = short.where("have = 0 AND n_split > 0").withColumn("in_split", F.col("i") % F.col("n_split")).join(slim(own, "split", "in_split"), ["split", "in_split"])
    by_all = short.where("have = 0 AND n_split = 0").withColumn("new", F.col("i") % F.col("n_all")).join(slim(newest, "new"), "new")
    made = None
    for part in (by_category, by_split, by_all):
        rows = part.select("split", "category", "place", "id", filled_query(F.col("category"), F.col("query_text")).alias("q")).select("split", "category", "place", "id", "q.*", F.lit(True).alias("made"))
        made = rows if made is None else made.union(rows)
    return taken.union(made)


def category_summary(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in names))


def latency_summary(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and count of the finite values not below 0 of each column."""
    aggregates = []
    for c in columns:
        good = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
        aggregates += [F.avg(F.when(good, F.col(c))).alias(f"avg_{c}"), F.count(F.when(good, 1)).alias(f"n_{c}")]
    return rows.groupBy(*(by or [])).agg(*aggregates)


def import_decisions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What an import does with each document: ``rows(document_id, url, title, checksum, version, seq)`` against
    ``known`` with the same columns.

    unchanged_content_skipped, duplicate_url_skipped, same_title_hash_skipped, updated or inserted. A key is
    taken by a known document, or else by the first row of the batch that has it.
    """
    keyed = lambda df: df.withColumns({"_u": F.struct("url", "checksum", F.coalesce("version", F.lit(""))), "_t": F.struct(T.term_key(F.col("title")), F.col("checksum"))})
    old = keyed(known)
    owner = lambda key, name: old.groupBy(key).agg(F.min("document_id").alias(name))
    same = known.select("document_id", F.struct("url", "title", "checksum", "version").alias("_old"))
    joined = keyed(rows).join(owner("_u", "_own_u"), "_u", "left").join(owner("_t", "_own_t"), "_t", "left").join(same, "document_id", "left")
    first = lambda key: F.first("document_id").over(Window.partitionBy(key).orderBy("seq", "document_id"))
    taken = joined.withColumns({"_own_u": F.coalesce("_own_u", first("_u")), "_own_t": F.coalesce("_own_t", first("_t"))})
    action = (
        F.when(F.col("_old").eqNullSafe(F.struct("url", "title", "checksum", "version")), "unchanged_content_skipped").when(F.col("_own_u") != F.col("document_id"), "duplicate_url_skipped")
        .when(F.col("_own_t") != F.col("document_id"), "same_title_hash_skipped").when(F.col("_old").isNotNull(), "updated").otherwise("inserted"))
    return taken.select("document_id", action.alias("action"))


def superseded(rows: DataFrame) -> DataFrame:
    """For each address the document of the newest ``seq`` is active; older ones name it."""
    newest = F.last("document_id").over(Window.partitionBy("url").orderBy("seq", "document_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("document_id", (newest == F.col("document_id")).alias("active"), F.when(newest != F.col("document_id"), newest).alias("superseded_by"))


def alias_dry_run(aliases: DataFrame) -> DataFrame:
    """Classes of a normalisation run over ``aliases(alias_id, term_id, stored, normal)``: invalid, conflict
    (another term has the normal form), unchanged or would_update."""
    shared = aliases.where("normal <> ''").groupBy("normal").agg(F.min("term_id").alias("_lo"), F.max("term_id").alias("_hi"))
    joined = aliases.join(shared, "normal", "left")
    kind = F.when(F.col("normal") == "", "invalid").when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("stored") == F.col("normal"), "unchanged").otherwise("would_update")
    return joined.select("alias_id", kind.alias("class"))


def remap_anchors(query_chunks: DataFrame, evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct ``(query_id, term_id)`` through the chunks of queries and the evidence of active terms."""
    return query_chunks.join(evidence, "chunk_id").join(terms.where("active").select("term_id"), "term_id", "left_semi").select("query_id", "term_id").distinct()


def choose_targets(plans: DataFrame, adjacency: DataFrame, seed: str = "plan", id_col: str = "chunk_id") -> DataFrame:
    """Planned queries with the chunks that they are about: ``answerability`` as it came out, and ``targets``, the source chunk first.

    ``adjacency(id, near, far)``, arrays of neighbours. A near or far query takes a drawn neighbour of its
    class; without any a near one; without these it is about its own chunk alone. A chunk is never its own neighbour.
    """
    joined = plans.join(adjacency.select(F.col(adjacency.columns[0]).alias(id_col), "near", "far"), id_col, "left")
    none = F.array().cast(adjacency.schema["near"].dataType)
    other = lambda c: F.filter(F.coalesce(F.col(c), none), lambda x: x != F.col(id_col))
    near, far = other("near"), other("far")
    wanted = F.col("answerability")
    kind = F.when((wanted == "far") & (F.size(far) > 0), "far").when((wanted != "single") & (F.size(near) > 0), "near").otherwise("single")
    pool = F.when(kind == "far", far).otherwise(near)
    drawn = F.get(pool, F.floor(hashed_unit(f"{seed}:target", F.col(id_col), F.col("seq")) * F.size(pool)).cast("int"))
    targets = F.when(kind == "single", F.array(F.col(id_col))).otherwise(F.array(F.col(id_col), drawn))
    return joined.select(*(c for c in plans.columns if c != "answerability"), kind.alias("answerability"), targets.alias("targets"))
