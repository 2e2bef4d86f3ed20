"""A sentiment model fitted on labelled rows: hashed words, a logistic model of three labels, calibrated on rows that it was not fitted on.

Fitting passes over the labelled rows as often as the optimiser asks for, wherever they lie; only gradients (three numbers for each of
2^BITS words) reach the driver. Scoring is columns alone."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scoring import LABELS, scored

BITS = 16
#: The penalty on absolute weights leaves most words without one; its size was chosen on the calibration fold.
ROUNDS, PENALTY = 60, 0.001
FOLDS = 5
#: Temperatures that calibration tries: below 1 the model is too timid, above too sure.
TEMPERATURES = tuple(round(0.25 * 1.15**k, 4) for k in range(25))
#: The least probability that a row counts with.
LEAST = 1e-9
#: What a row without words weighs for each label, so that the model has all three whatever the rows have.
TRACE = 1e-6


def fold(key: str) -> Column:
    """0: held out; 1: for calibration; others: for fitting. Of the key alone, so that a row is in the same fold whatever else there is."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def words(text: Column) -> Column:
    """The distinct lower-cased runs of letters of a text; null has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))


def _features(rows: DataFrame, text: str) -> DataFrame:
    return HashingTF(numFeatures=1 << BITS, inputCol="_words", outputCol="_features", binary=True).transform(rows.withColumn("_words", words(F.col(text))))


def _softmax(margins: Column, temperature: float) -> Column:
    """Probabilities of margins, none of which overflows."""
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp((m - top) / F.lit(temperature)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


@dataclass
class TrainedScorer:
    """A scorer whose probabilities are columns; `scored` takes it as it takes any other. version: a digest of what it computes with."""

    model: LogisticRegressionModel
    temperature: float = 1.0
    name: str = "hashed-words"

    @property
    def version(self) -> str:
        of = [np.ascontiguousarray(self.model.coefficientMatrix.toArray()).tobytes(), self.model.interceptVector.toArray().tobytes(), json.dumps([BITS, self.temperature]).encode()]
        return hashlib.sha256(b"".join(of)).hexdigest()[:16]

    def margins(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with _margins, one for each of LABELS."""
        model = self.model.copy()
        model.setFeaturesCol("_features").setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
        return model.transform(_features(rows, text)).select(*rows.columns, vector_to_array("_raw").alias("_margins"))

    def with_probabilities(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        of = self.margins(rows, text).withColumn("_margins", _softmax(F.col("_margins"), self.temperature))
        return of.select(*rows.columns, F.struct(*[F.get("_margins", F.lit(k)).alias(f"p_{x}") for k, x in enumerate(LABELS)]).alias(name))

    def save(self, path: str) -> str:
        """Writes the model to a folder and gives its version."""
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(self.temperature, self.name, self.version)], "temperature double, name string, version string").coalesce(1).write.mode("overwrite").json(f"{path}/how")
        return self.version


def load(spark: SparkSession, path: str, version: str) -> TrainedScorer:
    """The model of a folder; one of another version than asked for is refused."""
    how = spark.read.schema("temperature double, name string").json(f"{path}/how").first()
    found = TrainedScorer(LogisticRegressionModel.load(f"{path}/model"), how.temperature, how.name)
    if found.version != version:
        raise ValueError(f"{path} holds version {found.version}, not {version}")
    return found


def fit(rows: DataFrame, text: str, label: str, key: str) -> TrainedScorer:
    """A scorer from the rows of the fitting folds, calibrated on those of fold 1. Rows whose label is none of LABELS are left out; labels count
    alike in sum, however rare. Raises where no row is left; without rows to calibrate on, the temperature is 1."""
    place = reduce(lambda x, k: x.when(F.col(label) == LABELS[k], F.lit(float(k))), range(1, len(LABELS)), F.when(F.col(label) == LABELS[0], F.lit(0.0)))
    rows = rows.select(F.col(text).alias("_text"), place.alias("_label"), fold(key).alias("_fold")).where("_label is not null and _fold <> 0")
    sizes = {r[0]: r[1] for r in rows.where("_fold > 1").groupBy("_label").count().collect()}
    if not sizes:
        raise ValueError("no labelled rows to fit on")
    weight = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, sum(sizes.values()) / len(sizes) / n)]), F.col("_label"))
    fitting = _features(rows.where("_fold > 1").withColumn("_weight", weight).unionByName(rows.sparkSession.createDataFrame([("", float(k), 2, TRACE) for k in range(len(LABELS))], "_text string, _label double, _fold int, _weight double")), "_text")
    how = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", family="multinomial", maxIter=ROUNDS, regParam=PENALTY, elasticNetParam=1.0, standardization=False)
    scorer = TrainedScorer(how.fit(fitting.select("_features", "_label", "_weight")))
    scorer.temperature = _temperature(scorer.margins(rows.where("_fold = 1"), "_text"))
    return scorer


def _temperature(margins: DataFrame) -> float:
    """The temperature at which the labels of rows (_margins, _label) are likeliest, all tried in one pass."""
    own = F.col("_label").cast("int")
    loss = lambda t: F.sum(-F.log(F.greatest(F.get(_softmax(F.col("_margins"), t), own), F.lit(LEAST))))
    found = margins.agg(*[loss(t).alias(str(k)) for k, t in enumerate(TEMPERATURES)]).first()
    return 1.0 if found[0] is None else min(zip(found, TEMPERATURES))[1]


def held_out(rows: DataFrame, text: str, label: str, key: str, scorer: TrainedScorer, bins: int = 10) -> DataFrame:
    """label, n, found (rows of the label that get it), told (rows that get it), and the model's mean error of being sure: how far the shares of right
    labels are from the likeliest label's probability, by tenths of it. Held-out rows only."""
    of = scored(rows.where(fold(key) == 0).where(F.col(label).isin(*LABELS)).select(F.col(label).alias("_truth"), F.col(text).alias("_t")), "_t", scorer)
    of = of.select("_truth", "label", F.greatest(*[f"p_{x}" for x in LABELS]).alias("sure"))
    right = (F.col("label") == F.col("_truth")).cast("long")
    binned = of.groupBy(F.least(F.floor(F.col("sure") * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.sum("sure").alias("sure"))
    error = binned.agg(F.try_divide(F.sum(F.abs(F.col("right") - F.col("sure"))), F.sum("n")).alias("calibration_error"))
    either = of.select(F.explode(F.array_distinct(F.array("_truth", "label"))).alias("of"), "_truth", "label")
    counts = either.groupBy(F.col("of").alias("label")).agg(F.count_if(F.col("_truth") == F.col("of")).alias("n"), F.count_if((F.col("_truth") == F.col("of")) & (F.col("label") == F.col("of"))).alias("found"), F.count_if(F.col("label") == F.col("of")).alias("told"))
    return counts.crossJoin(error)
