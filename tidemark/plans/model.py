"""The default-probability model: encoding, boosted trees, calibration."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution
from ..operators.boosting import Forest, TreeParams, boost
from ..operators.encoding import SUFFIX, TargetEncoding, fit_target_encoding
from ..operators.features import CATEGORICAL_FEATURES, FEATURE_COLUMNS, NUMERIC_FEATURES
from ..operators.isotonic import IsotonicCurve, fit_isotonic
from ..session import materialise

CATEGORICAL_ENCODING = "target_encoder"
# Missing numbers stay missing: every split has learned a side for them.
INPUTS = (*NUMERIC_FEATURES, *[f"{c}{SUFFIX}" for c in CATEGORICAL_FEATURES])
# Attributions are reported per feature.
INPUT_GROUPS = tuple((c, (f"{c}{SUFFIX}" if c in CATEGORICAL_FEATURES else c,)) for c in FEATURE_COLUMNS)


@dataclass(frozen=True)
class ModelParams:
    """Settings of the learner."""

    # The defaults of the full-size model.
    n_estimators: int = 400
    max_depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 5.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    max_bins: int = 255
    calibration_method: str = "isotonic"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.calibration_method not in ("isotonic", "sigmoid"):
            raise ValueError(f"unknown calibration method {self.calibration_method!r}")

    def learner(self) -> TreeParams:
        return TreeParams(
            trees=self.n_estimators,
            depth=self.max_depth,
            learning_rate=self.learning_rate,
            subsample=self.subsample,
            colsample=self.colsample,
            min_child_weight=self.min_child_weight,
            l2=self.reg_lambda,
            gamma=self.gamma,
            max_bins=self.max_bins,
            seed=self.seed,
        )


def _numeric(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in NUMERIC_FEATURES})


@dataclass(frozen=True)
class ScoringModel:
    """Everything needed to score feature rows; applying it never shuffles while levels are few."""

    encoding: TargetEncoding
    forest: Forest
    calibrator: IsotonicCurve | LogisticRegressionModel | None
    params: ModelParams
    path: str | None = None

    def design(self, features: DataFrame) -> DataFrame:
        """``features`` with the model's input columns."""
        return _numeric(self.encoding.transform(features))

    def raw_scores(self, features: DataFrame) -> DataFrame:
        """Add ``margin`` (log-odds) and the uncalibrated ``raw_score`` to the design rows."""
        scored = self.design(features).withColumn("margin", self.forest.margin(features.sparkSession))
        return scored.withColumn("raw_score", 1 / (1 + F.exp(-F.col("margin"))))

    def score(self, features: DataFrame) -> DataFrame:
        """Design rows plus ``margin``, ``raw_score`` and the calibrated ``score``."""
        raw = self.raw_scores(features)
        if self.calibrator is None:
            return raw.withColumn("score", F.col("raw_score"))
        if isinstance(self.calibrator, IsotonicCurve):
            return self.calibrator.transform(raw, "raw_score", "score")
        margin = VectorAssembler(inputCols=["margin"], outputCol="margin_vector").transform(raw)
        out = self.calibrator.transform(margin)
        return out.withColumn("score", vector_to_array("calibrated")[1]).drop("margin_vector", "calibrated")

    def explain(self, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Per-row base value and contributions of the uncalibrated trees, on the log-odds scale."""
        return attribution.attribute_rows(self.design(features), self.tree_tables(), INPUTS, INPUT_GROUPS, keep=keep)

    def importance(self, features: DataFrame) -> DataFrame:
        """Mean absolute contribution per feature over all rows."""
        return attribution.mean_contributions(self.design(features), self.tree_tables(), INPUTS, INPUT_GROUPS)

    def tree_tables(self) -> attribution.TreeTables:
        trees = self.forest.trees
        return attribution.tables_of([t.nodes() for t in trees], [1.0] * len(trees), self.forest.base)

    def save(self, path: str) -> None:
        spark = self.encoding.levels.sparkSession
        self.encoding.levels.write.mode("overwrite").parquet(f"{path}/levels")
        self.forest.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        if isinstance(self.calibrator, IsotonicCurve):
            self.calibrator.save(f"{path}/calibrator")
        elif self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        meta = {"prior": self.encoding.prior, "params": asdict(self.params), "calibrated": self.calibrator is not None}
        # Written last: a folder with it is a complete model.
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        params = ModelParams(**meta["params"])
        calibrator = None
        if meta["calibrated"]:
            kind = IsotonicCurve if params.calibration_method == "isotonic" else LogisticRegressionModel
            calibrator = kind.load(spark, f"{path}/calibrator") if kind is IsotonicCurve else kind.load(f"{path}/calibrator")
        encoding = TargetEncoding(spark.read.parquet(f"{path}/levels"), meta["prior"], CATEGORICAL_FEATURES)
        return cls(encoding, Forest.of_table(spark.read.parquet(f"{path}/trees"), INPUTS), calibrator, params, path)


def fit_base(base: DataFrame, params: ModelParams, target: str = "Default", id_column: str = "id") -> ScoringModel:
    """Encoding and trees fitted on ``base``; not calibrated yet."""
    crossfit = fit_target_encoding(base, target=target, id_column=id_column, seed=params.seed)
    rows = _numeric(crossfit.transform_train(base))
    train = materialise(rows.select(f"`{id_column}`", *INPUTS, f"`{target}`"), "design")
    forest = boost(train, INPUTS, params.learner(), label=target, id_column=id_column)
    encoding = TargetEncoding(materialise(crossfit.encoding.levels, "levels"), crossfit.encoding.prior, CATEGORICAL_FEATURES)
    return ScoringModel(encoding, forest, None, params)


def calibrate(model: ScoringModel, held_out: DataFrame, target: str = "Default") -> ScoringModel:
    """Fit the calibrator on rows the trees have not seen; the trees stay as they are."""
    y = F.col(f"`{target}`").cast("double")
    scored = model.raw_scores(held_out)
    if model.params.calibration_method == "isotonic":
        fitted = fit_isotonic(scored.select("raw_score", y.alias("y")))
    else:
        fitted = _platt(scored.select("margin", y.alias("y")))
    return ScoringModel(model.encoding, model.forest, fitted, model.params)


def _platt(scored: DataFrame) -> LogisticRegressionModel:
    """Logistic curve on the margin with Platt's (1999) softened targets.

    A soft target t is two weighted rows: label 1 with weight t, label 0 with weight 1 - t.
    """
    sums = scored.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = sums["pos"], sums["n"] - sums["pos"]
    soft = F.when(F.col("y") == 1, F.lit((pos + 1) / (pos + 2))).otherwise(F.lit(1 / (neg + 2)))
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), soft.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - soft).alias("w"))
    )
    rows = scored.select("margin", F.inline(sides))
    rows = VectorAssembler(inputCols=["margin"], outputCol="margin_vector").transform(rows)
    return LogisticRegression(
        featuresCol="margin_vector",
        labelCol="label",
        weightCol="w",
        probabilityCol="calibrated",
        rawPredictionCol="",
        predictionCol="",
        standardization=False,
        tol=1e-9,
        maxIter=200,
    ).fit(rows)
