"""Ranking of numeric features against a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import numeric_columns, text_columns
from sievework.functions.order_stats import exact_quantiles
from sievework.operators.encode import label_encode, levels_of
from sievework.operators.missing import fill_zero
from sievework.session import parallelism, union_rows


def _features(df: DataFrame, target: str | None, features: Sequence[str] | None) -> list[str]:
    return [c for c in (features or numeric_columns(df)) if c != target]


def _unpivot(wide: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias(value)) for i, c in enumerate(names)]
    return wide.select(F.inline(F.array(*rows)))


def by_correlation(df: DataFrame, target: str, n: int = 5, features: Sequence[str] | None = None) -> DataFrame:
    """The n features of highest and the n of lowest correlation with the target."""
    names = _features(df, target, features)
    scores = _unpivot(df.agg(*[F.corr(c, target).alias(f"s{i}") for i, c in enumerate(names)]), names, "correlation")
    scores = scores.where("correlation IS NOT NULL")
    top = scores.orderBy(F.desc("correlation"), "feature").limit(n).withColumn("side", F.lit("top"))
    bottom = scores.orderBy("correlation", F.desc("feature")).limit(n).withColumn("side", F.lit("bottom"))
    return union_rows([top, bottom])


def by_variance(df: DataFrame, n: int = 5, features: Sequence[str] | None = None) -> DataFrame:
    names = _features(df, None, features)
    scores = _unpivot(df.agg(*[F.var_samp(c).alias(f"s{i}") for i, c in enumerate(names)]), names, "variance")
    return scores.where("variance IS NOT NULL").orderBy(F.desc("variance"), "feature").limit(n)


def by_forest(df: DataFrame, target: str, n: int = 5, features: Sequence[str] | None = None, trees: int = 100, seed: int = 42) -> DataFrame:
    """Random-forest importance, NULL features as 0; a text target means classes."""
    names = _features(df, target, features)
    classes = target in text_columns(df)
    rows = df.where(F.col(target).isNotNull()).select(target, *[F.col(c).cast("double").alias(c) for c in names])
    rows = fill_zero(rows, names)
    rows = label_encode(rows, target, "label") if classes else rows.withColumn("label", F.col(target).cast("double"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    made = RandomForestClassifier if classes else RandomForestRegressor
    # Tree building makes many passes: spread the rows evenly over all cores, whatever their values.
    model = made(numTrees=trees, seed=seed).fit(rows.select("features", "label").repartition(parallelism(df)))
    got = [(c, float(v)) for c, v in zip(names, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(got, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def _quantile_code(x: Column, edges: Sequence[float]) -> Column:
    """Number of distinct inner quantile edges below x."""
    code = F.lit(0)
    for e in sorted(set(edges)):
        code = code + (x > F.lit(float(e))).cast("int")
    return code


def by_mutual_information(df: DataFrame, target: str, n: int = 5, features: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between equal-frequency bins of each feature and of the target.

    NULL features count as 0.  One (feature, bin, target bin) count, combined on the map side,
    leaves at most features x bins x bins rows for the rest.
    """
    names = _features(df, target, features)
    classes = target in text_columns(df)
    rows = fill_zero(
        df.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in names], F.col(target).alias("_t")), names
    )
    cols = names if classes else [*names, "_t"]
    inner = exact_quantiles(rows, cols, [i / bins for i in range(1, bins)])
    y = F.col("_t").cast("string") if classes else _quantile_code(F.col("_t"), inner["_t"]).cast("string")
    long = rows.select(
        y.alias("y"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), _quantile_code(F.col(c), inner[c]).alias("x")) for c in names])),
    )
    joint = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    px = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    full = joint.join(px, ["feature", "x"]).join(py, ["feature", "y"]).join(total, "feature")
    mi = F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    return full.groupBy("feature").agg(mi.alias("score")).orderBy(F.desc("score"), "feature").limit(n)


def by_f_test(df: DataFrame, target: str, n: int = 5, features: Sequence[str] | None = None) -> DataFrame:
    """ANOVA F for a text target or at most 10 distinct values, else the F of the correlation.

    Rows with a missing feature are left out.
    """
    names = _features(df, target, features)
    rows = df.select(target, *names).na.drop(subset=names)
    classes = target in text_columns(df)
    if not classes:
        try:
            levels_of(rows, target, 10)
            classes = True
        except ValueError:
            classes = False
    if classes:
        k = rows.where(F.col(target).isNotNull()).groupBy(target).agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[e for i, c in enumerate(names) for e in (F.avg(c).alias(f"m{i}"), F.var_samp(c).alias(f"v{i}"))],
        )
        aggs = []
        for i in range(len(names)):
            nm = F.col("n") * F.col(f"m{i}")
            between = F.sum(nm * F.col(f"m{i}")) - F.try_divide(F.sum(nm) * F.sum(nm), F.sum("n"))
            within = F.sum(F.coalesce((F.col("n") - 1) * F.col(f"v{i}"), F.lit(0.0)))
            groups = F.count(F.lit(1))
            aggs.append(F.try_divide(F.try_divide(between, groups - 1), F.try_divide(within, F.sum("n") - groups)).alias(f"s{i}"))
        wide = k.agg(*aggs)
    else:
        aggs = []
        for i, c in enumerate(names):
            r2 = F.pow(F.corr(c, target), F.lit(2))
            aggs.append(F.try_divide(r2 * (F.count(F.lit(1)) - 2), 1 - r2).alias(f"s{i}"))
        wide = rows.agg(*aggs)
    return _unpivot(wide, names, "score").where("score IS NOT NULL").orderBy(F.desc("score"), "feature").limit(n)


def keep_features(df: DataFrame, ranking: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Only the ranked columns (a handful of names) and the given others."""
    return df.select(*others, *[r["feature"] for r in ranking.select("feature").collect()])
