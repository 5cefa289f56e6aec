"""Learning a match probability from pair features, and applying it."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import boosting
from tessella.operators.features import columns

SEED = 42
#: As the reference has them: a bound of rounds, and a depth of its 127 leaves.
MOST_ROUNDS, DEPTH = 4000, 7
#: Rows of a training task. A round is some ten jobs, so tasks of few rows cost more than they do.
FEWEST_ROWS, MOST_ROWS = 2000, 200_000


def split(df: DataFrame, key: str = "s1_id") -> DataFrame:
    """`df` with `part`: train, calibrate or test (60, 20, 20 %) by a hash of the entity, so that none is in two. Its
    first 32 bits count, which any engine can take from an MD5; a null key is an empty one."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit(f"|{SEED}"))), 1, 8), 16, 10).cast("bigint") % 10
    return df.withColumn("part", F.when(h < 6, "train").when(h < 8, "calibrate").otherwise("test"))


def label(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """`pairs` with label 1 where `links` (s1_id, target_id) has them, else 0."""
    true = links.select("s1_id", "target_id").distinct().withColumn("hit", F.lit(1))
    return pairs.join(true, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0)).cast("double")).drop("hit")


def dealt(d: DataFrame) -> DataFrame:
    """`d` cached, in as many partitions as training has use for: the cores, unless that leaves a task too few rows or too
    many. Rows of a partition are sorted, so that reruns draw the same ones."""
    d = d.persist()
    rows, cores = d.count(), d.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(cores, rows // FEWEST_ROWS), -(-rows // MOST_ROWS))
    out = d.repartition(n).sortWithinPartitions(*d.columns).persist()
    out.count()
    d.unpersist()
    return out


def train(data: DataFrame, cross_source: bool = True, rounds: int = MOST_ROUNDS, depth: int = DEPTH) -> PipelineModel:
    """Boosted trees on rows (features, label, part). The calibration part ends training: at the first round whose gain
    there is under a hundredth of the loss (Spark's validationTol); `rounds` is only a bound that should not bind. Rows that
    one task takes are learned from in one, more by Spark's jobs for each round."""
    names = columns(cross_source)
    d = data.filter("part <> 'test'").select(*names, "label", (F.col("part") == "calibrate").alias("held")).persist()
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.9", minInstancesPerNode=5, seed=SEED, validationIndicatorCol="held")
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    if d.count() <= MOST_ROWS:
        fitted = PipelineModel([vectors, boosting.fit(trees, d, names)])
    else:
        d = dealt(d)
        fitted = Pipeline(stages=[vectors, trees]).fit(d)
    d.unpersist()
    return fitted


def apply(model: PipelineModel, data: DataFrame) -> DataFrame:
    """`data` with prob, stored as float."""
    return model.transform(data).withColumn("prob", vector_to_array("probability")[1].cast("float")).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, n: int = 15) -> list[tuple[str, float]]:
    names, values = model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def calibrate(scored: DataFrame):
    """An isotonic fit of label on prob over the calibration part; an option that nothing applies by itself."""
    return IsotonicRegression(featuresCol="prob", labelCol="label").fit(scored.filter("part = 'calibrate'").withColumn("prob", F.col("prob").cast("double")))


def save(model: PipelineModel, path: str, cross_source: bool) -> None:
    model.write().overwrite().save(f"{path}/model")
    _session().createDataFrame([(json.dumps({"features": columns(cross_source), "cross_source": cross_source}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str) -> tuple[PipelineModel, dict]:
    """The model and its metadata; an order of features that is not ours raises ValueError."""
    meta = json.loads(_session().read.text(f"{path}/meta").first()[0])
    model = PipelineModel.load(f"{path}/model")
    if model.stages[0].getInputCols() != meta["features"] or meta["features"] != columns(meta["cross_source"]):
        raise ValueError("the model was trained on other features")
    return model, meta


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()
