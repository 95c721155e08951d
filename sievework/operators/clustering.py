"""Clustering of scaled numeric features, profiles of clusters, principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.missing import fill_mean
from sievework.operators.neighbors import density_clusters
from sievework.operators.transform import Scaler, fit_scaler
from sievework.session import cut_lineage


def _scaled(df: DataFrame, key: str, features: Sequence[str]) -> tuple[DataFrame, Scaler]:
    """(key, features...) with gaps filled by the mean and population scaling, written once
    because fits and searches read it many times."""
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in features])
    filled = fill_mean(rows, list(features))
    scaler = fit_scaler(filled, list(features), "standard")
    return cut_lineage(scaler.transform(filled)), scaler


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*features)))


def cluster(
    df: DataFrame, key: str, features: Sequence[str], method: str = "kmeans", n_clusters: int = 3, eps: float = 0.5, min_points: int = 5, seed: int = 42
) -> DataFrame:
    """(key, cluster).  'hierarchical' divides top-down (bisecting k-means): agglomeration needs
    all pairwise distances, which no large table allows."""
    scaled, _ = _scaled(df, key, features)
    if method == "dbscan":
        return density_clusters(scaled, key, features, eps, min_points).select(key, "cluster")
    made = {"kmeans": KMeans, "hierarchical": BisectingKMeans}[method]
    rows = _vector(scaled, features)
    model = made(k=n_clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, "cluster")


def attach_clusters(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows without a label get cluster -1."""
    return df.join(labels, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def cluster_profile(df: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Size, percentage of all rows, mean and sample deviation per feature; noise left out."""
    total = df.agg(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("size")]
    for c in features:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    out = df.where(F.col(label) >= 0).groupBy(label).agg(*aggs)
    return out.select(label, "size", (F.col("size") * 100.0 / total).alias("percentage"), *[c for c in out.columns if c not in (label, "size")])


def kmeans_centroids(df: DataFrame, key: str, features: Sequence[str], n_clusters: int = 3, seed: int = 42) -> DataFrame:
    """Cluster centres in the units of the features."""
    scaled, scaler = _scaled(df, key, features)
    model = KMeans(k=n_clusters, seed=seed, featuresCol="features").fit(_vector(scaled, features))
    rows = [(i, *[float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in features)
    return scaler.inverse(df.sparkSession.createDataFrame(rows, schema))


def principal_components(df: DataFrame, key: str, features: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """(key, pc1, pc2, ...) of the scaled features and the explained variance shares."""
    scaled, _ = _scaled(df, key, features)
    rows = _vector(scaled, features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(rows)
    out = model.transform(rows).withColumn("pc", vector_to_array("pc"))
    return out.select(key, *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)]), [float(v) for v in model.explainedVariance]
