"""Queries for models, clustering, neighbours and feature ranking."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sievework.operators import clustering, models, neighbors, selection
from sievework.plans.registry import query, rounded, table
from sievework.session import cut_lineage, ensure_checkpoint_dir, union_rows


def _customers(spark, sf_dir):
    """Balance, number of orders, spend and nation per customer, with gaps in balance and spend."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").select(
        "c_custkey",
        F.when(key % 11 != 0, F.col("c_acctbal") / 1000).alias("balance"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
        F.when(key % 7 != 0, F.coalesce("spend", F.lit(0.0)) / 97000).alias("spend"),
    )
    return cut_lineage(rows)


CUSTOMERS = """(SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 1000 END AS balance, coalesce(n, 0)::DOUBLE AS n_orders,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE coalesce(s, 0.0::DOUBLE) / 97000 END AS spend FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def _knn_fill_sql(target: str, others: tuple[str, str]) -> str:
    a, b = others
    shared = f"((g.{a} IS NOT NULL AND d.{a} IS NOT NULL)::INTEGER + (g.{b} IS NOT NULL AND d.{b} IS NOT NULL)::INTEGER)"
    d2 = f"(coalesce((g.{a} - d.{a}) * (g.{a} - d.{a}), 0) + coalesce((g.{b} - d.{b}) * (g.{b} - d.{b}), 0))"
    return f"""SELECT c_custkey, avg(v) AS v FROM (SELECT g.c_custkey, d.{target} AS v, row_number() OVER (PARTITION BY g.c_custkey ORDER BY sqrt({d2}) * sqrt(3.0::DOUBLE / {shared}), d.c_custkey) AS r
    FROM c g JOIN c d ON g.{target} IS NULL AND d.{target} IS NOT NULL AND {shared} > 0) WHERE r <= 5 GROUP BY 1"""


@query(
    "i05_nearest_fill",
    f"""WITH c AS (SELECT * FROM {CUSTOMERS}), fb AS ({_knn_fill_sql('balance', ('n_orders', 'spend'))}), fs AS ({_knn_fill_sql('spend', ('balance', 'n_orders'))})
    SELECT c.c_custkey, round(coalesce(balance, fb.v), 6) AS balance, n_orders, round(coalesce(spend, fs.v), 6) AS spend FROM c LEFT JOIN fb USING (c_custkey) LEFT JOIN fs ON fs.c_custkey = c.c_custkey""",
)
def nearest_fill(spark, sf_dir):
    return rounded(neighbors.fill_nearest(_customers(spark, sf_dir), "c_custkey", ["balance", "n_orders", "spend"], 5))


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_linenumber"]


def _lines(spark, sf_dir):
    """Line items with a status that depends on quantity, price and discount."""
    li = table(spark, sf_dir, "lineitem")
    points = F.col("l_quantity") / 50 + F.col("l_extendedprice") / 100000 - F.col("l_discount") * 5
    grade = F.when(points > 1.0, "high").when(points > 0.4, "medium").otherwise("low")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(key.alias("line"), *LINE_FEATURES, grade.alias("grade"), (points + F.col("l_tax")).alias("points"))


_BUCKET = "('0x' || substr(md5({} || ':42'), 1, 8))::BIGINT % 1000"


@query("m01_split", f"SELECT o_orderkey, CASE WHEN {_BUCKET.format('o_orderkey')} < 200 THEN 'test' ELSE 'train' END AS part FROM orders")
def split(spark, sf_dir):
    fit, test = models.split_rows(table(spark, sf_dir, "orders"), "o_orderkey", 0.2)
    parts = [fit.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))]
    return union_rows(parts).select("o_orderkey", "part")


@query(
    "m02_feature_triage",
    """SELECT c AS "column", p AS pct_missing, n AS n_levels, CASE WHEN kind = 'n' AND p <= 0.3 THEN 'numeric' WHEN n < 50 THEN 'categorical' ELSE 'skipped' END AS role FROM (
    SELECT 'p_size' AS c, 'n' AS kind, avg((p_size IS NULL)::INTEGER) AS p, NULL::BIGINT AS n FROM part UNION ALL
    SELECT 'gappy', 'n', round(avg((p_partkey % 2 = 0)::INTEGER), 6), NULL FROM part UNION ALL
    SELECT 'p_brand', 't', avg((p_brand IS NULL)::INTEGER), count(DISTINCT p_brand) FROM part UNION ALL
    SELECT 'p_name', 't', avg((p_name IS NULL)::INTEGER), count(DISTINCT p_name) FROM part)""",
)
def feature_triage(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("gappy", F.when(F.col("p_partkey") % 2 != 0, F.col("p_size")))
    return rounded(models.triage(p, ["p_size", "gappy", "p_brand", "p_name"]))


@query(
    "m03_numeric_preparation",
    """SELECT p_brand, round(coalesce(size, (SELECT avg(CASE WHEN p_partkey % 9 <> 0 THEN p_size END) FROM part WHERE p_partkey % 13 <> 0)), 6) AS size
    FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS size FROM part) WHERE p_brand IS NOT NULL""",
)
def numeric_preparation(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 13 != 0, F.col("p_brand")).alias("p_brand"), F.when(key % 9 != 0, F.col("p_size")).cast("double").alias("size")
    )
    rows, cols = models.prepare_numeric(p, ["p_partkey", "size"], "p_brand")
    return rounded(rows.select("p_brand", *cols))


def _trained(spark, sf_dir, model, target="grade", **params):
    return models.train(_lines(spark, sf_dir), "line", LINE_FEATURES, target, model, **params)


@query(
    "m04_preprocess",
    """WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, l_quantity AS a, l_linenumber::DOUBLE AS b, (l_linestatus = 'O')::INTEGER::DOUBLE AS c FROM lineitem),
    s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, avg(c) AS mc, stddev_samp(c) AS sc FROM r)
    SELECT line, round((a - ma) / sa, 6) + 0.0 AS quantity, round((b - mb) / sb, 6) + 0.0 AS line_number, round((c - mc) / sc, 6) + 0.0 AS status_open FROM r, s""",
)
def preprocess(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    stages, _ = models.preprocessing(rows, ["l_quantity", "l_linenumber"], ["l_linestatus"])
    out = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("v", vector_to_array("features"))
    return rounded(out.select("line", *[F.col("v")[i].alias(n) for i, n in enumerate(("quantity", "line_number", "status_open"))]))


def _register_classifier(name: str, model: str, **params):
    @query(name)
    def run(spark, sf_dir):
        return rounded(_trained(spark, sf_dir, model, **params).metrics)

    return run


_register_classifier("m05_logistic_regression", "logistic_regression")
_register_classifier("m05_decision_tree", "decision_tree_classifier")
_register_classifier("m05_random_forest", "random_forest_classifier")
_register_classifier("m05_naive_bayes", "naive_bayes")
_register_classifier("m06_linear_svm", "svm_classifier")
_register_classifier("m10_linear_regressor", "linear_regression", target="points")
_register_classifier("m10_decision_tree_regressor", "decision_tree_regressor", target="points")
_register_classifier("m10_random_forest_regressor", "random_forest_regressor", target="points")


def _embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


@query(
    "m07_nearest_classifier",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    d AS (SELECT q.vec_id AS id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, t.e), t.vec_id) AS r FROM e q, e t)
    SELECT id, first(label ORDER BY n DESC, label) AS prediction FROM (SELECT id, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL) GROUP BY 1""",
)
def nearest_classifier(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return neighbors.classify_nearest(e, e, "label", 5)


@query("m07_nearest_classifier_trained")
def nearest_classifier_trained(spark, sf_dir):
    scored, _ = models.train_vector_model(_lines(spark, sf_dir), "line", LINE_FEATURES[:4], "grade", "knn_classifier", k=5)
    return scored


@query("m08_boosted_stumps")
def boosted_stumps(spark, sf_dir):
    return rounded(models.train_vector_model(_lines(spark, sf_dir), "line", LINE_FEATURES[:4], "grade", "adaboost")[1])


@query("m09_discriminant")
def discriminant(spark, sf_dir):
    return rounded(models.train_vector_model(_lines(spark, sf_dir), "line", LINE_FEATURES[:4], "grade", "lda")[1])


@query(
    "m10_linear_regression_line",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem",
)
def linear_regression_line(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept")), 6, intercept=4)


def _predictions(spark, sf_dir):
    """A rule as the model: the flag guessed from quantity."""
    li = table(spark, sf_dir, "lineitem")
    guess = F.when(F.col("l_quantity") > 33, "A").when(F.col("l_quantity") > 16, "N").otherwise("R")
    return li.select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


_PREDICTED = "(SELECT l_returnflag AS l, CASE WHEN l_quantity > 33 THEN 'A' WHEN l_quantity > 16 THEN 'N' ELSE 'R' END AS p FROM lineitem)"
_REPORT = f"""(SELECT k AS label, coalesce(hit / nullif(pred, 0), 0) AS precision, coalesce(hit / nullif(sup, 0), 0) AS recall, sup AS support, hit FROM (
  SELECT k, count(*) FILTER (l = k) AS sup, count(*) FILTER (p = k) AS pred, count(*) FILTER (l = k AND p = k) AS hit FROM {_PREDICTED}, (VALUES ('A'), ('N'), ('R')) AS v(k) GROUP BY 1))"""


@query(
    "m11_class_report",
    f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, support FROM {_REPORT}",
)
def class_report(spark, sf_dir):
    return rounded(models.class_report(_predictions(spark, sf_dir)).drop("hits"))


@query(
    "m11_classification_metrics",
    f"""SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(2 * precision * recall / (precision + recall) * support) / sum(support), 6) AS f1 FROM {_REPORT}""",
)
def classification_metrics(spark, sf_dir):
    return rounded(models.classification_metrics(_predictions(spark, sf_dir)))


@query(
    "m12_regression_metrics",
    """SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(avg(e * e), 2) AS mse, round(avg(abs(e)), 4) AS mae FROM (SELECT l_extendedprice AS y, l_extendedprice - 2100 * l_quantity AS e FROM lineitem)""",
)
def regression_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (2100 * F.col("l_quantity")).alias("prediction"))
    return rounded(models.regression_metrics(li), 6, mse=2, mae=4)


@query("m13_feature_importance")
def importance(spark, sf_dir):
    return rounded(models.feature_importance(_trained(spark, sf_dir, "logistic_regression")))


@query("m14_batch_scoring")
def batch_scoring(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return _trained(spark, sf_dir, "logistic_regression").score(lines).select("line", "prediction", "probabilities")


@query("m15_saved_model")
def saved_model(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    _trained(spark, sf_dir, "linear_regression", "points").save(path)
    return rounded(models.Trained.load(spark, path).score(_lines(spark, sf_dir)).select("line", "prediction"))


# One feature: the fit on the training rows is the least-squares line.

_ORDER_FIT = f"(SELECT regr_slope(o_totalprice, x) AS b, regr_intercept(o_totalprice, x) AS a, stddev_samp(x) AS s FROM {{}} WHERE {_BUCKET.format('o_orderkey')} >= 200)"
_ORDERS_X = "(SELECT o_orderkey, o_totalprice, (o_custkey % 97)::DOUBLE AS x FROM orders)"


def _order_line(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).cast("double").alias("x"))
    return o, models.train(o, "o_orderkey", ["x"], "o_totalprice", "linear_regression")


# One feature: a tree grown to its end gives every value of it a leaf of its own.


@query(
    "m10_tree_leaf_means",
    f"""SELECT o_orderkey, round(m, 2) AS prediction FROM {_ORDERS_X} JOIN (SELECT x, avg(o_totalprice) AS m FROM {_ORDERS_X} WHERE {_BUCKET.format('o_orderkey')} >= 200 GROUP BY x) USING (x)""",
)
def tree_leaf_means(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).cast("double").alias("x"))
    return rounded(models.train(o, "o_orderkey", ["x"], "o_totalprice", "decision_tree_regressor").score(o).select("o_orderkey", "prediction"), 2)


@query(
    "m05_tree_leaf_classes",
    f"""WITH r AS (SELECT o_orderkey, o_orderpriority AS c, (o_custkey % 97)::DOUBLE AS x FROM orders),
    n AS (SELECT x, c, count(*) AS n FROM r WHERE {_BUCKET.format('o_orderkey')} >= 200 GROUP BY ALL)
    SELECT o_orderkey, prediction FROM r JOIN (SELECT x, first(c ORDER BY n DESC, c) AS prediction FROM n GROUP BY x) USING (x)""",
)
def tree_leaf_classes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 97).cast("double").alias("x"))
    return models.train(o, "o_orderkey", ["x"], "o_orderpriority", "decision_tree_classifier").score(o).select("o_orderkey", "prediction")


@query("m14_batch_scoring_line", f"SELECT o_orderkey, round(a + b * x, 3) AS prediction FROM {_ORDERS_X}, {_ORDER_FIT.format(_ORDERS_X)}")
def batch_scoring_line(spark, sf_dir):
    o, line = _order_line(spark, sf_dir)
    return rounded(line.score(o).select("o_orderkey", "prediction"), 3)


@query("m13_importance_line", f"SELECT 'x' AS feature, round(abs(b) * s, 3) AS importance FROM {_ORDER_FIT.format(_ORDERS_X)}")
def importance_line(spark, sf_dir):
    return rounded(models.feature_importance(_order_line(spark, sf_dir)[1]), 3)


@query(
    "m15_saved_model_line",
    f"""SELECT round(1 - sum(e * e) / (var_pop(o_totalprice) * count(*)), 6) AS r2, round(avg(abs(e)), 3) AS mae
    FROM (SELECT o_totalprice, o_totalprice - a - b * x AS e FROM {_ORDERS_X}, {_ORDER_FIT.format(_ORDERS_X)} WHERE {_BUCKET.format('o_orderkey')} < 200)""",
)
def saved_model_line(spark, sf_dir):
    """Saved, loaded and saved again with its metrics; a loaded model still knows its features."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    _order_line(spark, sf_dir)[1].save(f"{path}/1")
    models.Trained.load(spark, f"{path}/1").save(f"{path}/2")
    loaded = models.Trained.load(spark, f"{path}/2")
    assert loaded.target == "o_totalprice" and models.feature_importance(loaded).count() == 1
    return rounded(loaded.metrics.select("r2", "mae"), 6, mae=3)


CLUSTER_FEATURES = ["balance", "n_orders", "spend"]


@query("m16_kmeans")
def kmeans(spark, sf_dir):
    return clustering.cluster(_customers(spark, sf_dir), "c_custkey", CLUSTER_FEATURES, "kmeans", 3)


@query("m16_kmeans_embeddings")
def kmeans_embeddings(spark, sf_dir):
    e = _embeddings(spark, sf_dir).withColumn("features", array_to_vector("x"))
    return KMeans(k=10, seed=42, predictionCol="cluster").fit(e).transform(e).select("id", "label", "cluster")


@query(
    "m17_density_clusters",
    f"""WITH RECURSIVE f AS (SELECT c_custkey AS id, coalesce(balance, avg(balance) OVER ()) AS a, n_orders AS b FROM {CUSTOMERS}),
    c AS (SELECT id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM f),
    near AS (SELECT p.id AS p, q.id AS q FROM c p JOIN c q ON (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) <= 0.15 * 0.15),
    core AS (SELECT p AS id FROM near GROUP BY 1 HAVING count(*) >= 5),
    links AS (SELECT p, q FROM near WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.id),
    comp AS (SELECT id, min(root) AS comp FROM reach GROUP BY 1),
    named AS (SELECT id, comp FROM comp UNION ALL SELECT n.p, min(comp) FROM near n JOIN comp ON comp.id = n.q WHERE n.p NOT IN (SELECT id FROM core) GROUP BY 1)
    SELECT c.id AS c_custkey, coalesce(k.cluster, -1) AS cluster FROM c LEFT JOIN named USING (id) LEFT JOIN (SELECT comp, (dense_rank() OVER (ORDER BY comp) - 1)::INTEGER AS cluster FROM comp GROUP BY 1) k ON k.comp = named.comp""",
)
def density(spark, sf_dir):
    return clustering.cluster(_customers(spark, sf_dir), "c_custkey", CLUSTER_FEATURES[:2], "dbscan", eps=0.15, min_points=5)


@query("m18_hierarchical")
def hierarchical(spark, sf_dir):
    return clustering.cluster(_customers(spark, sf_dir), "c_custkey", CLUSTER_FEATURES, "hierarchical", 3)


@query(
    "m19_cluster_profile",
    """SELECT cluster, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS percentage, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std
    FROM (SELECT (o_custkey % 5 - 1)::BIGINT AS cluster, o_totalprice / 97 AS o_totalprice FROM orders) WHERE cluster >= 0 GROUP BY 1""",
)
def cluster_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5 - 1).alias("cluster"), (F.col("o_totalprice") / 97).alias("o_totalprice"))
    return rounded(clustering.cluster_profile(o, ["o_totalprice"]), 4, percentage=6)


@query("m20_centroids")
def centroids(spark, sf_dir):
    return rounded(clustering.kmeans_centroids(_customers(spark, sf_dir), "c_custkey", CLUSTER_FEATURES))


@query("m21_principal_components")
def components(spark, sf_dir):
    return rounded(clustering.principal_components(_customers(spark, sf_dir), "c_custkey", CLUSTER_FEATURES)[0])


@query(
    "m21_explained_two_features",
    f"""WITH c AS (SELECT coalesce(balance, avg(balance) OVER ()) AS x, n_orders AS y FROM {CUSTOMERS}), r AS (SELECT abs(corr(x, y)) AS r FROM c)
    SELECT 1 AS component, round((1 + r) / 2, 6) AS explained FROM r UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r""",
)
def explained_two_features(spark, sf_dir):
    """Two scaled features of correlation r have components of variance 1 + r and 1 - r."""
    _, shares = clustering.principal_components(_customers(spark, sf_dir), "c_custkey", ["balance", "n_orders"])
    return rounded(spark.createDataFrame(list(enumerate(shares, 1)), "component int, explained double"))


_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) + 0.0 AS correlation FROM lineitem" for c in _NUMBERS)


@query(
    "m22_rank_by_correlation",
    f"""WITH s AS ({_CORR}) (SELECT feature, correlation, 'top' AS side FROM s ORDER BY correlation DESC, feature LIMIT 2)
    UNION ALL (SELECT feature, correlation, 'bottom' FROM s ORDER BY correlation, feature DESC LIMIT 2)""",
)
def rank_by_correlation(spark, sf_dir):
    return rounded(selection.by_correlation(table(spark, sf_dir, "lineitem"), "l_extendedprice", 2, _NUMBERS))


@query(
    "m23_rank_by_variance",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance FROM lineitem" for c in _NUMBERS) + ") ORDER BY variance DESC, feature LIMIT 3",
)
def rank_by_variance(spark, sf_dir):
    return rounded(selection.by_variance(table(spark, sf_dir, "lineitem"), 3, _NUMBERS))


@query("m24_rank_by_forest")
def rank_by_forest(spark, sf_dir):
    return rounded(selection.by_forest(_lines(spark, sf_dir), "grade", 4, LINE_FEATURES[:4]))


def _mi_sql() -> str:
    probs = "[" + ", ".join(f"{i / 10!r}" for i in range(1, 10)) + "]"
    names = [*_NUMBERS[:4], "l_extendedprice"]
    edges = ", ".join(f"quantile_cont({c}, {probs}) AS q_{c}" for c in names)
    code = {c: f"len(list_filter(list_distinct(q_{c}), lambda e: e < {c}))" for c in names}
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {code[c]} AS x, {code['l_extendedprice']} AS y FROM lineitem, e" for c in names[:-1])
    return f"""WITH e AS (SELECT {edges} FROM lineitem), l AS ({parts}), j AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM l GROUP BY ALL)
    SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM j)
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"""


@query("m25_rank_by_information", _mi_sql())
def rank_by_information(spark, sf_dir):
    return rounded(selection.by_mutual_information(table(spark, sf_dir, "lineitem"), "l_extendedprice", 4, _NUMBERS[:4]))


def _f_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((ssb / (k - 1)) / (ssw / (t - k)), 6) AS score FROM (SELECT sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb, sum((n - 1) * v) AS ssw, count(*) AS k, sum(n) AS t
    FROM (SELECT l_returnflag, count(*)::DOUBLE AS n, avg({c}) AS m, var_samp({c}) AS v FROM lineitem GROUP BY 1))"""


@query("m26_rank_by_f_classes", "SELECT * FROM (" + " UNION ALL ".join(_f_sql(c) for c in _NUMBERS) + ") ORDER BY score DESC, feature LIMIT 3")
def rank_by_f_classes(spark, sf_dir):
    return rounded(selection.by_f_test(table(spark, sf_dir, "lineitem"), "l_returnflag", 3, _NUMBERS))


@query(
    "m26_rank_by_f_regression",
    "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 4) AS score FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in _NUMBERS)
    + ") ORDER BY score DESC, feature LIMIT 3",
)
def rank_by_f_regression(spark, sf_dir):
    return rounded(selection.by_f_test(table(spark, sf_dir, "lineitem"), "l_extendedprice", 3, _NUMBERS), 4)


@query("c10_penalised_regressions")
def penalised_regressions(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    return rounded(models.train_penalised(rows, "c_custkey", ["balance", "n_orders"], "spend"))


# --- joins of learned results ------------------------------------------------------------


@query(
    "j02_scores_to_rows",
    "SELECT c_custkey, c_name, round(c_acctbal / 3, 6) AS score FROM customer",
)
def scores_to_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    scores = c.select("c_custkey", (F.col("c_acctbal") / 3).alias("score"))
    return rounded(c.select("c_custkey", "c_name").join(scores, "c_custkey"))


@query(
    "j03_cluster_labels",
    """SELECT c_custkey, coalesce(cluster, -1) AS cluster FROM customer LEFT JOIN (SELECT o_custkey, least(count(*) // 5, 3)::INTEGER AS cluster FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 2) ON o_custkey = c_custkey""",
)
def cluster_labels(spark, sf_dir):
    """Customers with more than two pending orders are grouped by their number; the rest have no label."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    labels = pending.where("n > 2").select("c_custkey", F.least(F.floor(F.col("n") / 5), F.lit(3)).cast("int").alias("cluster"))
    return clustering.attach_clusters(table(spark, sf_dir, "customer").select("c_custkey"), labels, "c_custkey")
