"""Statistical tests: one row with statistic, degrees of freedom, p and a reading at .05.

Every test reduces the data to counts, means and variances in one aggregation (combined on
the map side) and works on those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import long_form, numeric_columns
from sievework.functions.probability import chi2_pvalue, f_pvalue, t_pvalue
from sievework.operators.profile import contingency

LEVEL = 0.05


def _verdict(yes: str, no: str) -> Column:
    return F.when(F.col("p_value") < LEVEL, yes).otherwise(no).alias("interpretation")


def one_sample_t(df: DataFrame, col: str, mean: float = 0.0) -> DataFrame:
    s = df.agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    t = F.try_divide(F.col("m") - F.lit(mean), F.try_divide(F.col("s"), F.sqrt(F.col("n"))))
    return (
        s.select(F.lit("One-sample t-test").alias("test_name"), t.alias("statistic"), (F.col("n") - 1).cast("double").alias("dof"))
        .withColumn("p_value", t_pvalue("statistic", "dof"))
        .select("*", _verdict(f"Mean differs from {mean:g}", f"Mean does not differ from {mean:g}"))
    )


def welch_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two columns as independent samples with unequal variances."""
    s = df.agg(
        *[e for c, t in ((a, "a"), (b, "b")) for e in (F.count(c).alias(f"n{t}"), F.avg(c).alias(f"m{t}"), F.var_samp(c).alias(f"v{t}"))]
    )
    ea, eb = F.try_divide(F.col("va"), F.col("na")), F.try_divide(F.col("vb"), F.col("nb"))
    dof = F.try_divide(F.pow(ea + eb, F.lit(2)), F.try_divide(ea * ea, F.col("na") - 1) + F.try_divide(eb * eb, F.col("nb") - 1))
    return (
        s.select(
            F.lit("Welch t-test").alias("test_name"),
            F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("statistic"),
            dof.alias("dof"),
        )
        .withColumn("p_value", t_pvalue("statistic", "dof"))
        .select("*", _verdict("Means differ", "No difference between means"))
    )


def _anova(groups: DataFrame) -> DataFrame:
    """F from one (n, m, v) row per group: group size, mean and sample variance."""
    s = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("m")).alias("sum"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("within"),
    )
    between = F.col("sq") - F.try_divide(F.col("sum") * F.col("sum"), F.col("total"))
    return s.select(
        F.lit("ANOVA").alias("test_name"),
        F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("total") - F.col("k"))).alias("statistic"),
        (F.col("k") - 1).cast("double").alias("dof_between"),
        (F.col("total") - F.col("k")).cast("double").alias("dof_within"),
    )


def _with_f_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", f_pvalue("statistic", "dof_between", "dof_within")).select(
        "*", _verdict("At least one group mean differs", "No difference between group means")
    )


def _group_moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    groups = _group_moments(df.where(F.col(group).isNotNull()), value, [group]).where("n > 0")
    return _with_f_pvalue(_anova(groups))


def anova_pooled(df: DataFrame, group: str, cols: Sequence[str] | None = None) -> DataFrame:
    """All numeric columns of complete rows pooled per category; groups need spread."""
    cols = list(cols or numeric_columns(df))
    whole = df.na.drop(how="any")
    pooled = long_form(whole, cols, "double", keep=[F.col(group).alias("_g")])
    groups = _group_moments(pooled, "value", ["_g"]).where("n > 1 AND v > 0")
    return _with_f_pvalue(_anova(groups))


def chi2_uniform(df: DataFrame, col: str) -> DataFrame:
    """Goodness of fit of the value counts to equal counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    s = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    return (
        s.select(
            F.lit("Chi-square goodness of fit").alias("test_name"),
            (F.try_divide(F.col("sq") * F.col("k"), F.col("t")) - F.col("t")).alias("statistic"),
            (F.col("k") - 1).cast("double").alias("dof"),
        )
        .withColumn("p_value", chi2_pvalue("statistic", "dof"))
        .select("*", _verdict("Distribution is not uniform", "No deviation from a uniform distribution"))
    )


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two categories of any number of levels; with one degree of freedom each deviation is cut
    by at most .5 (Yates).

    The statistic is N (sum n^2 / (row * column) - 1) over the cells that occur.  In a 2x2 table all
    four deviations are equal, so one cell and the totals give the corrected one.  One level on a
    side: no degree of freedom, statistic and p are NULL.
    """
    cells = contingency(df, a, b)
    total = F.sum("n")
    s = cells.agg(
        total.alias("t"),
        F.sum(F.col("n").cast("double") * F.col("n") / F.col("n_row") / F.col("n_col")).alias("q"),
        F.max(F.struct(F.col("n").cast("double").alias("n"), "n_row", "n_col")).alias("c"),
    )
    sides = [cells.groupBy(k).agg(F.first(m).alias("m")).agg(F.count(F.lit(1)).alias(f"k{i}"), F.sum(1 / F.col("m")).alias(f"h{i}")) for i, k, m in ((1, a, "n_row"), (2, b, "n_col"))]
    one = [side.select(F.struct("*")).scalar() for side in sides]
    s = s.select("*", one[0]["k1"].alias("ka"), one[1]["k2"].alias("kb"), one[0]["h1"].alias("ha"), one[1]["h2"].alias("hb"))
    d = F.abs(F.col("c.n") - F.col("c.n_row") * F.col("c.n_col") / F.col("t"))
    cut = d - F.least(F.lit(0.5), d)
    s = s.select("ka", "kb", (F.col("t") * (F.col("q") - 1)).alias("plain"), (cut * cut * F.col("t") * F.col("ha") * F.col("hb")).alias("yates"))
    dof = ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("double")
    return (
        s.select(
            F.lit("Chi-square independence").alias("test_name"),
            F.when(dof == 1, F.col("yates")).when(dof > 0, F.col("plain")).alias("statistic"),
            dof.alias("dof"),
        )
        .withColumn("p_value", chi2_pvalue("statistic", "dof"))
        .select("*", _verdict("Variables are dependent", "Variables are independent"))
    )


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """r over rows where both columns are known, with strength and direction."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    s = df.agg(F.corr(a, b).alias("r"), F.count_if(both).alias("n"))
    r = F.col("statistic")
    size = F.abs(r)
    return (
        s.select(F.lit("Pearson correlation").alias("test_name"), F.col("r").alias("statistic"), (F.col("n") - 2).cast("double").alias("dof"))
        .withColumn("_t", F.try_divide(r * F.sqrt(F.col("dof")), F.sqrt(1 - r * r)))
        .withColumn("p_value", F.when(size >= 1, 0.0).otherwise(t_pvalue("_t", "dof")))
        .select(
            "test_name",
            "statistic",
            "dof",
            "p_value",
            _verdict("Significant correlation", "No significant correlation"),
            F.when(size < 0.3, "weak").when(size < 0.7, "moderate").otherwise("strong").alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        )
    )
