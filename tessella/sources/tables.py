"""Sources and sinks: tab-separated records, truths and id lists, embeddings, cached statistics and candidates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def _lines(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """The header, and rows (ordinal, value) of the other lines; ordinals follow the file's order."""
    d = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    first = d.orderBy("ordinal").first()
    return (None, d) if first is None else (first["value"], d.filter(F.col("ordinal") > first["ordinal"]))


def read_source(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Rows (SOURCE_COLUMNS, ordinal) of a tab-separated file without quoting. A header that is not exactly
    SOURCE_COLUMNS raises ValueError; lines of fewer fields are left out, further fields ignored."""
    header, d = _lines(spark, path)
    if header is None or tuple(header.split("\t")) != SOURCE_COLUMNS:
        raise ValueError(f"{path}: header {header!r} is not {SOURCE_COLUMNS}")
    f = F.split("value", "\t", -1)
    d = d.filter(F.size(f) >= 4).select(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(SOURCE_COLUMNS)), "ordinal")
    return d if country is None else d.filter(F.col("country") == country)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows (s1_id, matched): comma lists without blanks and repeats; of repeated ids the last line counts."""
    _, d = _lines(spark, path)
    f = F.split("value", "\t", -1)
    d = d.select(F.get(f, F.lit(0)).alias("s1_id"), F.coalesce(F.get(f, F.lit(1)), F.lit("")).alias("m"), "ordinal").filter("s1_id <> ''")
    last = d.groupBy("s1_id").agg(F.max_by("m", "ordinal").alias("m"))
    return last.select("s1_id", F.array_distinct(F.filter(F.split("m", ","), lambda x: x != "")).alias("matched"))


def complete(s1: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (s1_id, ids, ordinal): one for each entity of `s1` (entity_id, ordinal), empty where nothing was chosen."""
    d = s1.select(F.col("entity_id").alias("s1_id"), "ordinal").join(chosen.select("s1_id", "ids"), "s1_id", "left")
    return d.select("s1_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "ordinal")


def first_rows(s1: DataFrame, n: int) -> DataFrame:
    """The first n records in file order."""
    return s1.orderBy("ordinal").limit(n)


def write_id_lists(rows: DataFrame, path: str, header: tuple[str, str] = TRUTH_HEADER, single_file: bool = False) -> None:
    """Text files of `id <tab> a,b,c` in the order of `ordinal`, each part file in its own range; with `single_file`
    one file that starts with the header. Without it the header is a file by itself, first by name."""
    spark = rows.sparkSession
    line = F.concat(F.col("s1_id"), F.lit("\t"), F.array_join("ids", ","))
    if single_file:
        head = spark.createDataFrame([(-1, "\t".join(header))], "ordinal long, value string")
        head.unionByName(rows.select("ordinal", line.alias("value"))).repartition(1).sortWithinPartitions("ordinal").select("value").write.mode("overwrite").text(path)
        return
    rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(line.alias("value")).write.mode("overwrite").text(f"{path}/rows")
    spark.createDataFrame([("\t".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_parts(candidates: DataFrame, path: str) -> None:
    """Candidates by country and chunk; written again, only the parts that are in `candidates` are replaced, so an
    interrupted run continues with those that lack."""
    candidates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country", "chunk").parquet(path)


def missing_parts(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Rows (country, chunk) of `expected` that `written` has no row of."""
    return expected.select("country", "chunk").distinct().join(written.select("country", "chunk").distinct(), ["country", "chunk"], "left_anti")


def write_cached(df: DataFrame, path: str, **meta) -> None:
    """A table with its metadata as one JSON row beside it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_cached(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows (entity_id, embedding), or None if there is no such table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def embedding_cosines(pairs: DataFrame, embeddings: DataFrame | None, latin: DataFrame) -> DataFrame:
    """`pairs` (s1_id, target_id) with emb_cos: only for targets whose name is not Latin and where both have vectors."""
    from tessella.functions.similarity import cosine

    if embeddings is None:
        return pairs.withColumn("emb_cos", F.lit(None).cast("double"))
    a = embeddings.select(F.col("entity_id").alias("s1_id"), F.col("embedding").alias("ea"))
    b = embeddings.join(latin.filter("not latin").select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("target_id"), F.col("embedding").alias("eb"))
    return pairs.join(a, "s1_id", "left").join(b, "target_id", "left").withColumn("emb_cos", cosine(F.col("ea"), F.col("eb"))).drop("ea", "eb")


def embedding_inputs(norm: DataFrame, all_targets: bool = False, s1_every: int = 1) -> DataFrame:
    """Ids whose names an encoder should see: reference records (every n-th), and targets whose names are not Latin."""
    from tessella.operators.records import keep_every

    s1 = norm.filter("source = 1")
    if s1_every > 1:
        s1 = s1.filter(keep_every(F.col("id_num"), s1_every))
    rest = norm.filter("source <> 1")
    return s1.select("entity_id").unionByName((rest if all_targets else rest.filter("not latin")).select("entity_id"))


def write_embeddings(names: DataFrame, encode, path: str, dim: int) -> None:
    """Unit vectors of rows (entity_id, business_name): `encode` turns a list of names into rows of `dim` numbers. One
    call for each Arrow batch; the model travels with the function."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            v = np.asarray(encode(b["business_name"].tolist()), np.float32).reshape(len(b), dim)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"entity_id": b["entity_id"], "embedding": list(v)})

    names.select("entity_id", F.coalesce("business_name", F.lit("")).alias("business_name")).mapInPandas(run, "entity_id string, embedding array<float>").write.mode("overwrite").parquet(path)


def check_complete(s1: DataFrame, *outputs: DataFrame) -> None:
    """Raise ValueError unless every output has as many rows as `s1`: nothing partial is packed."""
    n = s1.count()
    found = [o.count() for o in outputs]
    if any(x != n for x in found):
        raise ValueError(f"{n} reference records, but outputs of {found} rows")


def ordinals(df: DataFrame, by: str) -> DataFrame:
    """`df` with ordinals in the order of a column, for tables that come without file order."""
    return df.withColumn("ordinal", F.row_number().over(W.orderBy(by)))
