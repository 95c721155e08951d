"""Supervised models on ``pyspark.ml``: preparation, training, metrics, scoring, saving."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.exprs import distinct_per_column, numeric_columns, per_column, text_columns
from sievework.operators.encode import label_decode, label_dictionary, label_encode, levels_of, one_hot_stage
from sievework.operators.missing import fill_mean
from sievework.operators.neighbors import classify_nearest
from sievework.operators.schema import id_like_columns
from sievework.operators.trees import Forest, TreeSpec, fit_forest
from sievework.session import cut_lineage, shuffles_dropped

MAX_CLASSES = 50


def _bucket(key: str, seed: int) -> Column:
    """0 to 999 from the md5 of key and seed."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000


def split_rows(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the md5 of key and seed: the same rows whatever the partitioning."""
    bucket = _bucket(key, seed)
    cut = round(test_share * 1000)
    return df.where(bucket >= cut), df.where(bucket < cut)


def triage(df: DataFrame, features: Sequence[str], max_levels: int = 50, max_missing: float = 0.3) -> DataFrame:
    """(column, role): numeric, categorical (text below ``max_levels`` values) or skipped."""
    numeric, text = set(numeric_columns(df)), set(text_columns(df))
    prof = per_column(
        df,
        list(features),
        {
            "pct_missing": lambda c: F.avg(F.col(c).isNull().cast("double")),
        },
    )
    wide = [c for c in features if c in text]
    if wide:
        levels = distinct_per_column(df, wide).withColumnRenamed("n_distinct", "n_levels")
        prof = prof.join(F.broadcast(levels), "column", "left")
    else:
        prof = prof.withColumn("n_levels", F.lit(None).cast("bigint"))
    is_numeric = F.col("column").isin(*numeric) if numeric else F.lit(False)
    role = (
        F.when(is_numeric & (F.col("pct_missing") <= max_missing), "numeric")
        .when(F.col("n_levels") < max_levels, "categorical")
        .otherwise("skipped")
    )
    return prof.withColumn("role", role)


def prepare_numeric(df: DataFrame, features: Sequence[str], target: str, missing: str = "mean") -> tuple[DataFrame, list[str]]:
    """Numeric features that are no identifiers; NULL targets dropped; NULL features filled or dropped."""
    cols = [c for c in features if c in numeric_columns(df)]
    ids = {r["column"] for r in id_like_columns(df.select(*cols)).where("is_id").collect()}
    cols = [c for c in cols if c not in ids]
    rows = df.where(F.col(target).isNotNull())
    rows = fill_mean(rows, cols) if missing == "mean" else rows.na.drop(subset=cols)
    return rows, cols


def preprocessing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True) -> tuple[list, list[str]]:
    """Stages that end in a ``features`` vector, and the names of its slots."""
    stages, slots = [], [*numeric]
    inputs = [f"{c}_filled" for c in numeric]
    if numeric:
        stages.append(Imputer(strategy="mean", inputCols=list(numeric), outputCols=inputs))
    hot, names = one_hot_stage(df, categorical)
    if hot is not None:
        stages.append(hot)
        slots += names
        inputs += names
    raw = "raw_features" if scale else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return stages, slots


def spread(df: DataFrame, key: str) -> DataFrame:
    """One shuffle by key ahead of an iterative fit, so that every pass uses all cores even if
    the input came in a few large pieces.  A key spreads evenly and repeats exactly on retry;
    adaptive execution picks the number of partitions.  Written once: a lost executor then
    costs a re-read, and each pass reads the projected rows only."""
    return cut_lineage(df.repartition(F.col(key)))


def _as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


#: What the models do if the caller says nothing: as many steps as it takes.
DEFAULTS = {
    "logistic_regression": {"maxIter": 1000},
    "svm_classifier": {"maxIter": 100},
}
TREES = ("decision_tree_classifier", "decision_tree_regressor", "random_forest_classifier", "random_forest_regressor")
VECTOR_MODELS = ("knn_classifier", "adaboost", "lda")


def estimator(name: str, **params):
    params = DEFAULTS.get(name, {}) | params
    made = {
        "logistic_regression": LogisticRegression,
        "naive_bayes": lambda **p: NaiveBayes(modelType="gaussian", **p),
        "svm_classifier": lambda **p: OneVsRest(classifier=LinearSVC(**p), parallelism=4),
        "linear_regression": LinearRegression,
    }
    if name not in made:
        raise ValueError(f"unknown model: {name}")
    return made[name](**params)


def tree_spec(name: str, slots: int, classes: int | None, seed: int, maxDepth: int | None = None, numTrees: int = 100, **params) -> TreeSpec:
    """Trees are grown to their end unless ``maxDepth`` says otherwise; forests of classes look at
    the square root of the features in each node, those of numbers at all."""
    if name.startswith("decision_tree"):
        return TreeSpec(classes=classes, max_depth=maxDepth, seed=seed, **params)
    few = max(1, int(slots**0.5)) if classes else None
    return TreeSpec(trees=numTrees, classes=classes, features=few, bootstrap=True, max_depth=maxDepth, seed=seed, **params)


def fit_own(name: str, points: DataFrame, key: str, slots: int, classes: int | None, seed: int, **params):
    """A model of this library on ``points`` (key, x, label)."""
    if name in TREES:
        return fit_forest(points, key, tree_spec(name, slots, classes, seed, **params))
    if name == "adaboost":
        return fit_boosted(points, **params)
    if name == "lda":
        return fit_discriminant(points)
    return Nearest(cut_lineage(points.select(F.col(key).alias("id"), "x", "label")), **params)


@dataclass
class Trained:
    """A fitted pipeline with what is needed to read its output; ``final`` is a model of this
    library after it, or None if the pipeline's last stage is the model."""

    model: PipelineModel
    problem: str
    slots: list[str]
    labels: list = field(default_factory=list)
    metrics: DataFrame | None = None
    doubles: list[str] = field(default_factory=list)
    target: str = ""
    description: str = ""
    final: Forest | Boosted | Discriminant | Nearest | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` as a number and, where there is one, ``probability``."""
        out = self.model.transform(df)
        if self.final is None:
            return out
        x = vector_to_array("features") if self.slots else F.array().cast("array<double>")
        return self.final.transform(out.select(*df.columns, x.alias("__x")), "__x").drop("__x")

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classes, ``probabilities`` by label where the model has them."""
        out = self.transform(_as_double(df, self.doubles))
        if self.problem != "classification":
            return out.select(*df.columns, F.col("prediction"))
        names = F.array(*[F.lit(str(v)) for v in self.labels])
        label = F.element_at(names, F.col("prediction").cast("int") + 1)
        cols = [*df.columns, label.alias("prediction")]
        if "probability" in out.columns:
            shares = "probability" if self.final is not None else vector_to_array("probability")
            cols.append(F.map_from_arrays(names, shares).alias("probabilities"))
        return out.select(*cols)

    def save(self, path: str) -> None:
        """Model, column roles, target, description and the metrics row."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        meta = {
            "problem": self.problem, "slots": self.slots, "labels": [str(v) for v in self.labels],
            "doubles": self.doubles, "target": self.target, "description": self.description,
        }
        if self.final is not None:
            self.final.save(f"{path}/final")
            meta["final"] = {"kind": self.final.kind, **self.final.meta()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if self.metrics is not None:
            self.metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")

    @staticmethod
    def load(spark, path: str, with_metrics: bool = True) -> Trained:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        metrics = spark.read.parquet(f"{path}/metrics") if with_metrics else None
        kinds = {c.kind: c for c in (Forest, Boosted, Discriminant, Nearest)}
        own = meta.get("final")
        return Trained(
            PipelineModel.load(f"{path}/model"), meta["problem"], meta["slots"], meta["labels"], metrics,
            meta["doubles"], meta["target"], meta["description"],
            kinds[own["kind"]].load(spark, f"{path}/final", own) if own else None,
        )


def train(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    model: str,
    test_share: float = 0.2,
    seed: int = 42,
    max_classes: int | None = MAX_CLASSES,
    description: str = "",
    **params,
) -> Trained:
    """Triage, encode, scale, split, fit, and measure on the held-out rows.

    More than ``max_classes`` classes are refused, as a target of that many is mostly a mistake;
    None lifts that.
    """
    problem = "regression" if model.endswith("regressor") or model == "linear_regression" else "classification"
    roles = {r["column"]: r["role"] for r in triage(df, features).collect()}
    numeric = [c for c in features if roles[c] == "numeric"]
    categorical = [c for c in features if roles[c] == "categorical"]
    rows = _as_double(df.where(F.col(target).isNotNull()), numeric)
    labels: list = []
    if problem == "classification":
        labels = levels_of(rows, target, max_classes)
        label = F.lit(None).cast("double")
        for i, v in enumerate(labels):
            label = F.when(F.col(target) == F.lit(v), float(i)).otherwise(label)
        rows = rows.withColumn("label", label)
    else:
        rows = rows.withColumn("label", F.col(target).cast("double"))
    own = model in TREES or model in VECTOR_MODELS
    # The passes of a fit neither read the key nor take its digest again.
    held = (_bucket(key, seed) < round(test_share * 1000)).alias("__held")
    rows = rows.select(key, *numeric, *categorical, "label", held).repartition(F.col(key))
    with shuffles_dropped(df.sparkSession):
        rows = cut_lineage(rows if own else rows.drop(key))
    fit_rows, test_rows = rows.where("NOT __held").drop("__held"), rows.where("__held").drop("__held")
    stages, slots = preprocessing(fit_rows, numeric, categorical)
    trained = Trained(None, problem, slots, labels, None, numeric, target, description)
    if own:
        trained.model = Pipeline(stages=stages).fit(fit_rows)
        points = trained.model.transform(fit_rows).select(key, vector_to_array("features").alias("x"), "label")
        trained.final = fit_own(model, points, key, len(slots), len(labels) or None, seed, **params)
    else:
        trained.model = Pipeline(stages=[*stages, estimator(model, **params)]).fit(fit_rows)
    scored = trained.transform(test_rows).select("label", "prediction")
    trained.metrics = classification_metrics(scored) if problem == "classification" else regression_metrics(scored)
    return trained


# --- metrics ------------------------------------------------------------------------------


def class_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    cells = scored.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    pairs = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("l").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
            )
        ),
        F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    sums = pairs.groupBy("label").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), (F.sum("hit") / 2).alias("hits")
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), "support", "hits").withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    ).select("label", "precision", "recall", "f1", "support", "hits")


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    report = class_report(scored, label, prediction)
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), n)

    return report.agg(
        F.try_divide(F.sum("hits"), n).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
    )


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return scored.agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def feature_importance(trained: Trained) -> DataFrame:
    """(feature, importance) by slot name: tree importances, weights of stumps, |coef|, or mean |coef| over classes."""
    last = trained.model.stages[-1]
    if trained.final is not None:
        values = trained.final.importance()
    elif hasattr(last, "models"):
        values = np.mean([np.abs(m.coefficients.toArray()) for m in last.models], axis=0)
    elif hasattr(last, "coefficientMatrix"):
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = np.abs(last.coefficients.toArray())
    else:
        raise ValueError("this model has no feature importance")
    spark = SparkSession.active()
    rows = [(s, float(v)) for s, v in zip(trained.slots, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# --- models Spark does not ship -----------------------------------------------------------


class Boosted:
    """Weighted votes of one-split trees (SAMME): (slot, cut, class below, class above, weight)."""

    kind = "boosted"

    def __init__(self, stumps: list[tuple[int, float, int, int, float]], classes: int, slots: int = 0):
        self.stumps, self.classes, self.slots = stumps, classes, slots

    def importance(self) -> np.ndarray:
        """Share of the votes' weight that each feature decides."""
        values = np.zeros(self.slots)
        for slot, *_, weight in self.stumps:
            values[slot] += weight
        return values / max(values.sum(), 1e-300)

    def meta(self) -> dict:
        return {"stumps": self.stumps, "classes": self.classes, "slots": self.slots}

    def save(self, path: str) -> None:
        """All is in the metadata."""

    @staticmethod
    def load(spark: SparkSession, path: str, meta: dict) -> Boosted:
        return Boosted([tuple(v) for v in meta["stumps"]], meta["classes"], meta["slots"])

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Adds ``prediction`` and ``probability``, the softmax of each class's votes against the others'."""
        k, weight = self.classes, sum(v[4] for v in self.stumps) or 1.0
        decided = F.transform(self._votes(x), lambda v: F.exp((v - (weight - v) / max(k - 1, 1)) / (weight * max(k - 1, 1))))
        out = df.withColumn("__p", decided)
        total = F.aggregate("__p", F.lit(0.0), lambda s, v: s + v)
        return self.predict(out.withColumn("probability", F.transform("__p", lambda v: v / total)), x).drop("__p")

    def predict(self, df: DataFrame, x: str = "x") -> DataFrame:
        ranked = F.transform(self._votes(x), lambda v, k: F.struct(v.alias("v"), (-k.cast("double")).alias("k")))
        return df.withColumn("prediction", -F.array_max(ranked)["k"])

    def _votes(self, x: str) -> Column:
        """Weight of the votes for every class; a formula of all stumps would be too long to compile."""
        stumps, classes = self.stumps, self.classes

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def votes(rows: pd.Series) -> pd.Series:
            sums = np.zeros((len(rows), classes))
            m = np.stack([np.asarray(v, dtype=float) for v in rows]) if len(rows) else np.zeros((0, 1))
            for slot, cut, below, above, weight in stumps:
                low = m[:, slot] < cut
                sums[low, below] += weight
                sums[~low, above] += weight
            return pd.Series(list(sums))

        return votes(F.col(x))


def _packed_bins(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Blocks of rows as two byte strings: the bin of every feature, feature after feature, and the labels."""
    limits = [np.array(c, dtype=float) for c in cuts]
    small = np.min_scalar_type(max(len(c) for c in cuts)) if cuts else np.uint8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(limits))
            codes = np.stack([np.searchsorted(c, m[:, j], side="right") for j, c in enumerate(limits)]).astype(small)
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (codes, labels)], ["codes", "labels"])

    return rows.mapInArrow(pack, "codes binary, labels binary")


def _weighted_cells(data: DataFrame, added: list[np.ndarray]) -> DataFrame:
    """(slot, code, label, w): sum of the weights e^(what the bins of a row add) of the packed rows."""
    slots, classes = len(added), added[0].shape[1]
    small = np.min_scalar_type(max(len(a) for a in added) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(a.size) for a in added]
        for batch in batches:
            for codes, labels in zip(batch.column("codes"), batch.column("labels")):
                y = np.frombuffer(labels.as_py(), dtype=np.int32)
                z = np.frombuffer(codes.as_py(), dtype=small).reshape(slots, len(y))
                cell = [z[j].astype(np.intp) * classes + y for j in range(slots)]
                w = np.exp(sum(a.ravel()[c] for a, c in zip(added, cell)))
                for own, c in zip(sums, cell):
                    own += np.bincount(c, weights=w, minlength=len(own))
        for j, own in enumerate(sums):
            at = np.flatnonzero(own)
            cols = [np.full(len(at), j, np.int32), (at // classes).astype(np.int32), (at % classes).astype(np.int32), own[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["slot", "code", "label", "w"])

    parts = data.mapInArrow(count, "slot int, code int, label int, w double")
    return parts.groupBy("slot", "code", "label").agg(F.sum("w").alias("w"))


def fit_boosted(df: DataFrame, x: str = "x", label: str = "label", rounds: int = 50, bins: int = 64) -> Boosted:
    """Boost depth-1 trees over quantile-binned features.

    ``x`` is an array of doubles and ``label`` runs over 0, 1, ....  The bins are written once, packed
    into blocks of rows; a round is one weighted count per (feature, bin, class) in numpy, small enough
    to choose the best split from on the driver.  What the stumps so far add to a row's weight is one
    number per (feature, bin, class), so a round costs the same however many there are.
    """
    rows = df.select(F.col(x).alias("x"), F.col(label).cast("int").alias("label"))
    size = rows.agg(F.max("label").alias("k"), F.max(F.size("x")).alias("d")).first()
    classes, slots = size["k"] + 1, size["d"]
    probs = [i / bins for i in range(1, bins)]
    sketch = rows.agg(*[F.percentile_approx(F.col("x")[j], probs, 10_000).alias(f"q{j}") for j in range(slots)]).first()
    cuts = [sorted(set(sketch[f"q{j}"])) for j in range(slots)]
    data = cut_lineage(_packed_bins(rows, cuts))
    stumps: list[tuple[int, float, int, int, float]] = []
    added = [np.zeros((len(c) + 1, classes)) for c in cuts]
    for _ in range(rounds):
        cells = _weighted_cells(data, added).collect()
        best = None
        for j in range(slots):
            table = np.zeros((len(cuts[j]) + 1, classes))
            for r in cells:
                if r["slot"] == j:
                    table[r["code"], r["label"]] = r["w"]
            below = table.cumsum(axis=0)
            above = below[-1] - below
            weight_b, weight_a = below.sum(axis=1), above.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                purity = np.nan_to_num((below**2).sum(axis=1) / weight_b) + np.nan_to_num((above**2).sum(axis=1) / weight_a)
            i = int(purity[:-1].argmax()) if len(cuts[j]) else 0
            if len(cuts[j]) and (best is None or purity[i] > best[0]):
                err = 1 - (below[i].max() + above[i].max()) / below[-1].sum()
                best = (purity[i], j, i, int(below[i].argmax()), int(above[i].argmax()), err)
        if best is None:
            break
        _, j, i, lo, hi, err = best
        alpha = float(np.log((1 - err) / max(err, 1e-10)) + np.log(max(classes - 1, 1)))
        if alpha <= 0:
            break
        stumps.append((j, cuts[j][i], lo, hi, alpha))
        missed = np.arange(classes) != np.where(np.arange(len(added[j])) <= i, lo, hi)[:, None]
        added[j] = added[j] + alpha * missed
        if err <= 1e-10:
            break
    return Boosted(stumps, classes, slots)


class Discriminant:
    """Linear scores from class means and the pooled covariance."""

    kind = "discriminant"

    def __init__(self, weights: np.ndarray, offsets: np.ndarray, priors: np.ndarray):
        self.weights, self.offsets, self.priors = weights, offsets, priors

    def importance(self) -> np.ndarray:
        """Mean over classes of |coefficient|, the coefficients taken about the overall mean."""
        return np.abs(self.weights - self.priors @ self.weights).mean(axis=0)

    def meta(self) -> dict:
        return {"weights": self.weights.tolist(), "offsets": self.offsets.tolist(), "priors": self.priors.tolist()}

    def save(self, path: str) -> None:
        """All is in the metadata."""

    @staticmethod
    def load(spark: SparkSession, path: str, meta: dict) -> Discriminant:
        return Discriminant(np.array(meta["weights"]), np.array(meta["offsets"]), np.array(meta["priors"]))

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Adds ``prediction`` and ``probability``, the softmax of the scores."""
        out = df.withColumn("__s", F.array(*[s["v"] for s in self._scores(x)]))
        raised = F.transform("__s", lambda v: F.exp(v - F.array_max("__s")))
        out = out.withColumn("__p", raised)
        total = F.aggregate("__p", F.lit(0.0), lambda s, v: s + v)
        return self.predict(out.withColumn("probability", F.transform("__p", lambda v: v / total)), x).drop("__s", "__p")

    def predict(self, df: DataFrame, x: str = "x") -> DataFrame:
        return df.withColumn("prediction", -F.array_max(F.array(*self._scores(x)))["k"])

    def _scores(self, x: str) -> list[Column]:
        scores = []
        for k, (w, b) in enumerate(zip(self.weights, self.offsets)):
            coef = F.array(*[F.lit(float(v)) for v in w])
            dot = F.aggregate(F.zip_with(F.col(x), coef, lambda a, c: a * c), F.lit(float(b)), lambda s, v: s + v)
            scores.append(F.struct(dot.alias("v"), F.lit(-float(k)).alias("k")))
        return scores


def fit_discriminant(df: DataFrame, x: str = "x", label: str = "label") -> Discriminant:
    """Class means and second moments come from one pass of small per-task sums."""
    data = df.select(F.col(x).alias("x"), F.col(label).cast("int").alias("label"))

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = np.stack([np.asarray(v, dtype=float) for v in pdf["x"]])
            z = np.column_stack([np.ones(len(z)), z])
            for k in np.unique(pdf["label"]):
                part = z[(pdf["label"] == k).to_numpy()]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        for k, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"label": np.int32(k), "i": i.astype("int32"), "j": j.astype("int32"), "v": m[i, j]})

    cells = (
        data.mapInPandas(partial, "label int, i int, j int, v double").groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    )
    classes = max(r["label"] for r in cells) + 1
    d = max(r["j"] for r in cells) + 1
    m = np.zeros((classes, d, d))
    for r in cells:
        m[r["label"], r["i"], r["j"]] = m[r["label"], r["j"], r["i"]] = r["v"]
    n = m[:, 0, 0]
    mean = m[:, 0, 1:] / n[:, None]
    within = sum(m[k, 1:, 1:] - n[k] * np.outer(mean[k], mean[k]) for k in range(classes)) / (n.sum() - classes)
    inverse = np.linalg.pinv(within)
    weights = mean @ inverse
    offsets = -0.5 * (weights * mean).sum(axis=1) + np.log(n / n.sum())
    return Discriminant(weights, offsets, n / n.sum())


class Nearest:
    """The training points of a nearest-neighbour classifier: id, x, label."""

    kind = "nearest"

    def __init__(self, points: DataFrame, k: int = 5, weights: str = "uniform"):
        self.points, self.k, self.weights = points, k, weights

    def importance(self) -> np.ndarray:
        raise ValueError("this model has no feature importance")

    def meta(self) -> dict:
        return {"k": self.k, "weights": self.weights}

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")

    @staticmethod
    def load(spark: SparkSession, path: str, meta: dict) -> Nearest:
        return Nearest(spark.read.parquet(f"{path}/points"), meta["k"], meta["weights"])

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
        asked = rows.select(F.col("__row").alias("id"), F.col(x).alias("x"))
        found = classify_nearest(self.points, asked, "label", self.k, self.weights).withColumnRenamed("id", "__row")
        return rows.join(found.withColumn("prediction", F.col("prediction").cast("double")), "__row", "left").drop("__row")


def train_vector_model(
    df: DataFrame, key: str, features: Sequence[str], target: str, model: str, test_share: float = 0.2, seed: int = 42, **params
) -> tuple[DataFrame, DataFrame]:
    """knn_classifier, adaboost or lda on scaled numeric features: (scored test rows, metrics)."""
    words = label_dictionary(df, target)
    rows = label_encode(df.where(F.col(target).isNotNull()).select(key, target, *features), target, "label")
    with shuffles_dropped(df.sparkSession):
        rows = spread(_as_double(rows, features), key)
    fit_rows, test_rows = split_rows(rows, key, test_share, seed)
    stages, _ = preprocessing(fit_rows, list(features), [])
    prep = Pipeline(stages=stages).fit(fit_rows)

    def vectors(part: DataFrame) -> DataFrame:
        return prep.transform(part).select(F.col(key).alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))

    fit_x, test_x = vectors(fit_rows), vectors(test_rows)
    if model == "knn_classifier":
        scored = test_x.join(classify_nearest(fit_x, test_x, "label", **params), "id").select("id", "label", "prediction")
    elif model == "adaboost":
        scored = fit_boosted(fit_x, **params).predict(test_x).select("id", "label", "prediction")
    elif model == "lda":
        scored = fit_discriminant(fit_x).predict(test_x).select("id", "label", "prediction")
    else:
        raise ValueError(model)
    named = label_decode(scored.withColumn("prediction", F.col("prediction").cast("int")), words, target, "prediction")
    return named.select(F.col("id").alias(key), "label", F.col("prediction").cast("double").alias("prediction"), F.col(f"{target}_decoded").alias("predicted")), classification_metrics(scored)


def train_penalised(
    df: DataFrame, key: str, features: Sequence[str], target: str, strength: float = 0.1, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Lasso and ridge side by side: error, R2, five-fold error and R2, coefficients."""
    rows = _as_double(df.where(F.col(target).isNotNull()), [*features, target]).withColumn("label", F.col(target))
    fit_rows, test_rows = split_rows(rows, key, test_share, seed)
    stages, slots = preprocessing(fit_rows, list(features), [])
    prep = Pipeline(stages=stages).fit(fit_rows)
    # Folds reuse the prepared rows: written once.
    fold = (_bucket(key, seed + 1) % 5).cast("int").alias("fold")
    fit_x = cut_lineage(prep.transform(fit_rows).select("features", "label", fold))
    test_x = prep.transform(test_rows).select("features", "label")
    out = []
    for name, mix in (("lasso", 1.0), ("ridge", 0.0)):
        lr = LinearRegression(regParam=strength, elasticNetParam=mix, standardization=False)
        # Each fold is fitted once and read for both metrics.
        held = [regression_metrics(lr.fit(fit_x.where(F.col("fold") != i)).transform(fit_x.where(F.col("fold") == i))).first() for i in range(5)]
        folds = {metric: float(np.mean([h[metric] for h in held if h[metric] is not None])) for metric in ("mse", "r2")}
        fitted = lr.fit(fit_x)
        got = regression_metrics(fitted.transform(test_x)).first()
        coefs = json.dumps(dict(zip(slots, [round(float(c), 6) for c in fitted.coefficients.toArray()])))
        out.append((name, got["mse"], got["r2"], folds["mse"], folds["r2"], coefs))
    return df.sparkSession.createDataFrame(out, "model string, mse double, r2 double, cv_mse double, cv_r2 double, coefficients string")
