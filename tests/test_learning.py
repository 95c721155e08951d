import os
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import session
from sievework.operators import clustering, models, neighbors, selection, trees


def cloud(spark, n, dims, seed=0, hot=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)), 3)
    x[: int(n * hot)] = x[0]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id bigint, x array<double>"), x


@pytest.mark.parametrize("dims,hot", [(2, 0.0), (5, 0.0), (3, 0.35)])
def test_nearest_join_equals_brute_force(spark, monkeypatch, dims, hot):
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    donors, d = cloud(spark, 600, dims, 1, hot)
    queries, q = cloud(spark, 150, dims, 2, hot)
    got = {}
    for r in neighbors.nearest_join(queries, donors, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["donor_id"]
    dist = np.sqrt(((q[:, None] - d[None]) ** 2).sum(axis=2))
    for i in range(len(q)):
        want = np.lexsort((np.arange(len(d)), dist[i]))[:4].tolist()
        mine = [got[i][k] for k in (1, 2, 3, 4)]
        assert dist[i][mine] == pytest.approx(dist[i][want])
        if len(set(np.round(dist[i][np.argsort(dist[i])[:5]], 9))) == 5:
            assert mine == want


def test_nearest_join_with_fewer_donors_than_k(spark):
    donors, _ = cloud(spark, 2, 2, 1)
    queries, _ = cloud(spark, 3, 2, 2)
    assert neighbors.nearest_join(queries, donors, 5).count() == 6


def test_nearest_join_of_wide_points_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    donors, d = cloud(spark, 300, 12, 1, 0.4)
    queries, q = cloud(spark, 70, 12, 2)
    both, all_q = queries.union(donors.where("id < 30").selectExpr("id + 1000", "x")), np.concatenate([q, d[:30]])
    got = {}
    for r in neighbors.nearest_join(both, donors, 3).collect():
        got.setdefault(r["query_id"] if r["query_id"] < 1000 else r["query_id"] - 930, {})[r["rank"]] = (r["donor_id"], r["dist"])
    dist = np.sqrt(((all_q[:, None] - d[None]) ** 2).sum(axis=2))
    for i in range(len(all_q)):
        want = np.lexsort((np.arange(len(d)), dist[i].round(12)))[:3].tolist()
        assert [got[i][k][0] for k in (1, 2, 3)] == want
        assert [got[i][k][1] for k in (1, 2, 3)] == pytest.approx(dist[i][want].tolist())


def test_regions_stay_small_however_many_points():
    # The number of regions grows with the points, so a query never meets more than about a block.
    x = np.random.default_rng(3).normal(size=(400_000, 4))
    regions = neighbors._Regions(x[::16], len(x), 5)
    sizes = np.bincount(regions.own(x))
    assert sizes.max() < 2 * neighbors.BLOCK and sizes[sizes > 0].min() >= 5
    q = x[:500]
    rows, cell = regions.within(q, np.full(500, 0.05))
    at = regions.own(x)
    for i in range(0, 500, 50):
        near = np.flatnonzero(((x - q[i]) ** 2).sum(axis=1) <= 0.05**2)
        assert set(at[near]) <= set(cell[rows == i])


def test_far_queries_visit_regions_in_bounded_memory():
    x = np.random.default_rng(3).uniform(size=(20_000, 2))
    regions = neighbors._Regions(x, 2_000 * neighbors.BLOCK, 5)
    far, bound = np.full((3_000, 2), 50.0), np.full(3_000, 100.0)
    leaves = int((regions.feature < 0).sum())
    assert leaves > 1_000
    tracemalloc.start()
    seen = np.zeros(len(far), dtype=np.int64)
    for rows, _ in regions.visits(far, bound):
        seen += np.bincount(rows, minlength=len(far))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (seen == leaves).all() and peak < 200e6


def test_nearest_fill(spark):
    data = [(1, 1.0, 10.0, "a"), (2, 2.0, 20.0, "a"), (3, 3.0, None, None), (4, 4.0, 40.0, "b"), (5, None, None, "a"), (6, None, 20.0, "a")]
    df = spark.createDataFrame(data, "id int, a double, b double, c string")
    got = {r["id"]: r for r in neighbors.fill_nearest(df, "id", ["a", "b", "c"], 2).collect()}
    assert got[3]["b"] == 30.0 and got[3]["c"] == "a"
    # No shared column: the column mean.
    assert got[5]["a"] == 2.5 and got[5]["b"] == pytest.approx(22.5)
    assert got[6]["a"] == 1.5


def brute_dbscan(x, eps, min_points):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_points
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo, label[i] = [i], k
        while todo:
            j = todo.pop()
            for m in np.flatnonzero(near[j]):
                if label[m] < 0:
                    label[m] = k
                    if core[m]:
                        todo.append(m)
        k += 1
    return label


@pytest.mark.parametrize("dims,eps,hot", [(2, 0.15, 0.0), (2, 0.15, 0.3), (4, 0.6, 0.0)])
def test_density_clusters_equal_brute_force(spark, monkeypatch, dims, eps, hot):
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    points, x = cloud(spark, 400, dims, 4, hot)
    df = points.select("id", *[F.col("x")[j].alias(f"c{j}") for j in range(dims)])
    got = neighbors.density_clusters(df, "id", [f"c{j}" for j in range(dims)], eps, 5).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_dbscan(x, eps, 5).tolist()


@pytest.mark.parametrize("dims,n,eps,min_points", [(1, 500, 0.01, 3), (2, 700, 0.1, 4), (2, 700, 0.12, 20), (2, 500, 0.3, 1), (3, 500, 0.4, 6)])
def test_density_grid_equals_brute_force(spark, monkeypatch, dims, n, eps, min_points):
    monkeypatch.setattr(neighbors, "BLOCK", 3)
    monkeypatch.delattr(neighbors, "_ball_blocks")
    points, x = cloud(spark, n, dims, 11, 0.02)
    df = points.select("id", *[F.col("x")[j].alias(f"c{j}") for j in range(dims)])
    got = neighbors.density_clusters(df, "id", [f"c{j}" for j in range(dims)], eps, min_points).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_dbscan(x, eps, min_points).tolist()


def test_density_clusters_of_crowded_points_do_not_meet_in_pairs(spark, monkeypatch):
    monkeypatch.delattr(neighbors, "_ball_blocks")
    rng = np.random.default_rng(5)
    # Two crowded squares 0.2 apart with one point between them, a far one, and one of no place.
    x = np.concatenate([rng.uniform(0, 1, (20_000, 2)), rng.uniform(0, 1, (20_000, 2)) + [1.2, 0], [[1.1, 0.5], [9.0, 9.0]]])
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(len(x), float("nan"), 0.0), (len(x) + 1, None, 0.0)]
    df = spark.createDataFrame(data, "id bigint, a double, b double")
    got = {r["id"]: r["cluster"] for r in neighbors.density_clusters(df, "id", ["a", "b"], 0.08, 5).collect()}
    assert all(got[i] == int(i >= 20_000) for i in range(40_000))
    assert [got[i] for i in range(40_000, 40_004)] == [-1, -1, -1, -1]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_density_clusters_far_away_or_with_repeated_keys(spark, offset):
    x = [0.0, 0.25, 0.5, 5.0, 5.25, 9.0]
    df = spark.createDataFrame([(i // (1 if offset else 2), offset + v) for i, v in enumerate(x)], "id bigint, a double")
    got = {r["a"] - offset: r["cluster"] for r in neighbors.density_clusters(df, "id", ["a"], 0.3, 2).collect()}
    want = dict(zip(x, [0, 0, 0, 1, 1, -1])) if offset else None
    assert len(got) == len(x) and (want is None or got == want)


def test_connected_components_of_a_path(spark, rows):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "id bigint")
    got = dict(rows(neighbors.connected_components(edges, nodes)))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200


def blobs(spark, n=300):
    rng = np.random.default_rng(7)
    data = []
    for i in range(n):
        k = i % 3
        a, b = rng.normal((0, 6, 12)[k], 0.6), rng.normal((0, 8, -8)[k], 0.6)
        data.append((i, float(a), float(b), ("red", "green", "blue")[k], "xyz"[k] if i % 10 else None, float(2 * a - b + rng.normal(0, 0.1))))
    return spark.createDataFrame(data, "id bigint, a double, b double, colour string, mark string, y double")


def test_passes_of_a_fit_read_neither_key_nor_digest(spark, monkeypatch):
    fit, seen = models.Pipeline.fit, []

    def spy(self, df, *args):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append(("id" in df.columns, "md5" in plan))
        return fit(self, df, *args)

    monkeypatch.setattr(models.Pipeline, "fit", spy)
    trained = models.train(blobs(spark), "id", ["a", "b"], "colour", "svm_classifier")
    assert seen == [(False, False)] and trained.metrics.first()["accuracy"] > 0.95


@pytest.mark.parametrize("name", ["logistic_regression", "decision_tree_classifier", "random_forest_classifier", "naive_bayes", "svm_classifier"])
def test_classifiers_separate_blobs(spark, name):
    t = models.train(blobs(spark), "id", ["a", "b", "mark"], "colour", name)
    assert t.metrics.first()["accuracy"] > 0.97
    scored = t.score(blobs(spark))
    assert scored.where("prediction = colour").count() > 290
    if name == "logistic_regression":
        p = scored.first()["probabilities"]
        assert set(p) == {"red", "green", "blue"} and sum(p.values()) == pytest.approx(1.0)
    if name != "naive_bayes":
        assert models.feature_importance(t).count() == 4


@pytest.mark.parametrize("name", ["knn_classifier", "adaboost", "lda"])
def test_own_classifiers_separate_blobs(spark, name):
    params = {"rounds": 10} if name == "adaboost" else {}
    scored, metrics = models.train_vector_model(blobs(spark), "id", ["a", "b"], "colour", name, **params)
    assert metrics.first()["accuracy"] > 0.97
    assert set(scored.columns) == {"id", "label", "prediction", "predicted"}


@pytest.mark.parametrize("name", ["linear_regression", "decision_tree_regressor", "random_forest_regressor"])
def test_regressors(spark, name, tmp_path):
    t = models.train(blobs(spark), "id", ["a", "b"], "y", name)
    assert t.metrics.first()["r2"] > 0.9
    t.save(str(tmp_path))
    again = models.Trained.load(spark, str(tmp_path))
    a = t.score(blobs(spark)).orderBy("id").collect()
    assert a == again.score(blobs(spark)).orderBy("id").collect()


def test_split_is_stable(spark):
    df = blobs(spark)
    one = {r["id"] for r in models.split_rows(df, "id")[1].collect()}
    two = {r["id"] for r in models.split_rows(df.repartition(7), "id")[1].collect()}
    assert one == two and 30 < len(one) < 90


def test_triage(spark):
    data = [(i, float(i) if i % 2 else None, f"t{i}", "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(data, "n int, gappy double, wide string, c string")
    got = {r["column"]: r["role"] for r in models.triage(df, df.columns).collect()}
    assert got == {"n": "numeric", "gappy": "skipped", "wide": "skipped", "c": "categorical"}


def test_penalised(spark):
    got = {r["model"]: r for r in models.train_penalised(blobs(spark), "id", ["a", "b"], "y").collect()}
    assert got["ridge"]["r2"] > 0.98 and got["lasso"]["cv_r2"] > 0.98


@pytest.mark.parametrize("method", ["kmeans", "hierarchical"])
def test_clusters_of_blobs(spark, method):
    df = blobs(spark)
    got = clustering.cluster(df, "id", ["a", "b"], method, 3).join(df, "id")
    assert got.groupBy("colour").agg(F.count_distinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1


def test_cluster_profile_and_join(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 9.0)], "id int, v double")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "id int, cluster int")
    joined = clustering.attach_clusters(df, labels, "id")
    assert sorted(r["cluster"] for r in joined.collect()) == [-1, 0, 0]
    got = clustering.cluster_profile(joined, ["v"]).collect()
    assert len(got) == 1 and got[0]["size"] == 2 and got[0]["v_mean"] == 2.0 and got[0]["percentage"] == pytest.approx(200 / 3)


def test_components_and_centroids(spark):
    df = blobs(spark)
    pcs, share = clustering.principal_components(df, "id", ["a", "b", "y"], 2)
    assert pcs.count() == 300 and share[0] >= share[1] and sum(share) > 0.95
    centres = sorted(r["a"] for r in clustering.kmeans_centroids(df, "id", ["a", "b"], 3).collect())
    assert centres == pytest.approx([0, 6, 12], abs=0.4)


def test_rankings(spark):
    rng = np.random.default_rng(3)
    data = [(float(v), float(2 * v + rng.normal(0, 0.1)), float(rng.normal()), "hi" if v > 0 else "lo") for v in rng.normal(size=400)]
    df = spark.createDataFrame(data, "x double, y double, noise double, g string")
    assert selection.by_correlation(df, "y", 1).where("side = 'top'").first()["feature"] == "x"
    assert selection.by_variance(df, 1).first()["feature"] == "y"
    assert selection.by_mutual_information(df, "y", 1).first()["feature"] == "x"
    assert selection.by_mutual_information(df, "g", 3).collect()[-1]["feature"] == "noise"
    assert selection.by_f_test(df, "y", 1).first()["feature"] == "x"
    assert selection.by_f_test(df, "g", 3).collect()[-1]["feature"] == "noise"
    assert selection.by_forest(df, "g", 3, trees=10).collect()[-1]["feature"] == "noise"
    kept = selection.keep_features(df, selection.by_f_test(df, "y", 1), ["g"])
    assert kept.columns == ["g", "x"]


def test_boosting_needs_several_stumps(spark):
    # A band: no single split separates it.
    data = [(i, [i / 100.0], 1 if 30 <= i < 60 else 0) for i in range(100)]
    df = spark.createDataFrame(data, "id int, x array<double>, label int")
    boosted = models.fit_boosted(df, rounds=20)
    assert len(boosted.stumps) > 1
    assert boosted.predict(df).where("prediction = label").count() >= 97


def test_boosting_rounds_cost_the_same(spark):
    # Rows are packed once and a round counts blocks of them, not a row per feature; the plan of a
    # prediction does not grow with the stumps.
    data = [(i, [float(i % 7), float(i % 11)], (i % 7 + i % 11) % 3) for i in range(400)]
    df = spark.createDataFrame(data, "id int, x array<double>, label int")
    packed = models._packed_bins(df.coalesce(1), [[1.0, 3.0], [5.0]])
    assert packed.count() == 1
    cells = models._weighted_cells(packed, [np.zeros((3, 3)), np.log(2) * np.ones((2, 3))]).collect()
    want = sum(2.0 for _, x, k in data if x[0] >= 3 and k == 1)
    assert sum(r["w"] for r in cells if (r["slot"], r["code"], r["label"]) == (0, 2, 1)) == pytest.approx(want)
    plans = []
    for n in (1, 40):
        many = models.Boosted([(i % 2, float(i % 5), 0, 2, 1.0 + i) for i in range(n)], 3, 2)
        plans.append(len(many.predict(df)._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[1] < plans[0] + 100


# --- trees --------------------------------------------------------------------------------


def plain_tree(x, y, w, classes):
    """Predictions of a grown-out tree by recursion over single cuts."""

    def loss(rows):
        v = [w[r] * (np.eye(classes)[int(y[r])] if classes else np.array([1.0, y[r], y[r] ** 2])) for r in rows]
        s, total = np.sum(v, axis=0), sum(w[r] for r in rows)
        return total - (s**2).sum() / total if classes else s[2] - s[1] ** 2 / total

    out = {}

    def visit(rows):
        cuts = []
        if len({y[r] for r in rows}) > 1:
            for j in range(x.shape[1]):
                values = sorted({x[r, j] for r in rows})
                for a, b in zip(values, values[1:]):
                    left, right = [r for r in rows if x[r, j] <= a], [r for r in rows if x[r, j] > a]
                    cuts.append((round(loss(left) + loss(right), 9), j, a, left, right))
        if cuts:
            *_, left, right = min(cuts, key=lambda c: c[:3])
            visit(left)
            visit(right)
        else:
            total = sum(w[r] for r in rows)
            value = [sum(w[r] for r in rows if y[r] == k) / total for k in range(classes)] if classes else [sum(w[r] * y[r] for r in rows) / total]
            out.update({r: value for r in rows})

    visit(list(range(len(x))))
    return np.array([out[r] for r in range(len(x))])


@pytest.mark.parametrize("classes", [None, 3])
def test_grown_tree_equals_recursion(classes):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        x = np.column_stack([rng.integers(0, 9, n), rng.random(n).round(1), np.ones(n)]).astype(float)
        y = rng.integers(0, 3, n).astype(float) if classes else rng.normal(size=n).round(1)
        w = rng.integers(1, 4, n).astype(float)
        part = trees.grow(x, y, w, trees.TreeSpec(classes=classes), [1], None)
        assert np.allclose(part.predict(x), plain_tree(x, y, w, classes))
        assert np.allclose(trees.Part.read(part.blob()).predict(x), part.predict(x))


def tree_rows(spark, n=4000, constant=False):
    rng = np.random.default_rng(5)
    data = []
    for i in range(n):
        a, b, c = (1.0 if constant else float(rng.integers(0, 40))), float(rng.normal()), float(rng.integers(0, 3))
        data.append((i, [a, b, c], float(3 * a + b * c), float((a > 20) + (b > 0) * (c > 1))))
    return spark.createDataFrame(data, "id long, x array<double>, y double, k double")


@pytest.mark.parametrize(("label", "classes"), [("y", None), ("k", 3)])
def test_histograms_above_and_exact_parts_below(spark, label, classes):
    rows = tree_rows(spark)
    spec = trees.TreeSpec(classes=classes, finish_rows=150)
    forest = trees.fit_forest(rows, "id", spec, y=label)
    assert forest.parts.count() > 20 and len(forest.tops[0].feature) > 40
    scored = forest.transform(rows.withColumn("truth", F.col(label)))
    assert scored.where(F.abs(F.col("prediction") - F.col("truth")) > 1e-9).count() == 0
    whole = trees.fit_forest(rows, "id", trees.TreeSpec(classes=classes), y=label)
    assert len(whole.tops[0].feature) == 1
    assert np.allclose(forest.importance(), whole.importance(), atol=0.05)


def test_large_nodes_of_equal_rows_end(spark):
    rows = spark.range(1000).select("id", F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("x"), (F.col("id") % 4).cast("double").alias("label"))
    forest = trees.fit_forest(rows, "id", trees.TreeSpec(finish_rows=100))
    got = {tuple(r.x): r.prediction for r in forest.transform(rows).select("x", "prediction").distinct().collect()}
    assert got == {(1.0, 0.0): 1.0, (1.0, 1.0): 2.0}


def test_narrow_nodes_get_cuts_of_their_own(spark):
    # One value holds nearly everything for the shared quantiles; the rest lies close together.
    data = [(i, [0.0 if i % 20 else 1 + i * 1e-6], float(i // 100)) for i in range(4000)]
    rows = spark.createDataFrame(data, "id long, x array<double>, label double")
    forest = trees.fit_forest(rows, "id", trees.TreeSpec(finish_rows=20, bins=4))
    off = forest.transform(rows.where("id % 20 = 0")).where(F.abs(F.col("prediction") - F.col("label")) > 1e-9)
    assert off.count() == 0


@pytest.mark.parametrize("shared", [0, 10**9])
def test_forest_by_either_way(spark, shared, monkeypatch):
    rows = tree_rows(spark, 1500)
    spec = trees.TreeSpec(trees=12, classes=3, features=2, bootstrap=True, shared_bytes=shared, finish_rows=1000 if shared == 0 else 10**6)
    forest = trees.fit_forest(rows, "id", spec, y="k")
    small = {r.id: (r.prediction, r.probability) for r in forest.transform(rows).collect()}
    monkeypatch.setattr(trees, "MODEL_BYTES", 0)
    monkeypatch.setattr(trees, "CHUNK_ROWS", 100)
    large = {r.id: (r.prediction, r.probability) for r in forest.transform(rows).collect()}
    assert set(small) == set(large)
    for i, (p, share) in small.items():
        assert share == pytest.approx(large[i][1]) and sum(share) == pytest.approx(1.0)
    truth = {r.id: r.k for r in rows.collect()}
    assert np.mean([small[i][0] == truth[i] for i in truth]) > 0.98
    again = trees.fit_forest(rows.repartition(7), "id", spec, y="k")
    monkeypatch.undo()
    assert {r.id: r.prediction for r in again.transform(rows).collect()} == {i: p for i, (p, _) in small.items()}


def test_rows_travel_packed(spark):
    # One row per part and batch instead of one per tree and row, and all drawn rows are in them.
    rows = tree_rows(spark, 3000).coalesce(1).select(F.xxhash64("id").alias("h"), "x", F.col("k").alias("y"))
    spec = trees.TreeSpec(trees=5, classes=3, features=2, bootstrap=True)
    tops = [trees.Top() for _ in range(5)]
    for top in tops:
        top.split(0, 0, 20.0)
    packed = trees._routed_blobs(rows, tops, 3, spec).collect()
    assert len(packed) == 10
    h = rows.toArrow().column("h").to_numpy()
    drawn = sum(int((trees.row_weights(h, t, spec) > 0).sum()) for t in range(5))
    assert sum(len(r["w"]) for r in packed) == drawn and sum(len(r["x"]) for r in packed) == drawn * 3 * 8
    x = np.frombuffer(packed[0]["x"], dtype=float).reshape(-1, 3)
    assert len({bool(v) for v in x[:, 0] <= 20.0}) == 1


@pytest.mark.parametrize(("label", "classes"), [("k", 3), ("y", None)])
def test_rows_go_to_a_few_trees_at_a_time(spark, label, classes, monkeypatch, tmp_path):
    # Rows times trees are never on disk at once, nor are all parts of a large forest; scores, gains and files are the same.
    rows = tree_rows(spark, 1500)
    spec = trees.TreeSpec(trees=5, classes=classes, features=2, bootstrap=True, shared_bytes=0, finish_rows=1000)
    whole = trees.fit_forest(rows, "id", spec, y=label)
    sent, routed = [], trees._routed_blobs

    def noted(data, tops, d, spec, which):
        sent.append(list(which))
        return routed(data, tops, d, spec, which)

    monkeypatch.setattr(trees, "_routed_blobs", noted)
    monkeypatch.setattr(trees, "ROUND_BYTES", 2 * (trees._grown_bytes(1500, 3, spec) + 1500 * (8 * 3 + 8 * (classes or 1) + 8)))
    forest = trees.fit_forest(rows, "id", spec, y=label)
    assert not sent
    a, b = ({r.id: (r.prediction, *r.asDict().get("probability", [])) for r in f.transform(rows).collect()} for f in (whole, forest))
    assert sent and max(map(len, sent)) <= 2 and sorted(sum(sent, [])) == [0, 1, 2, 3, 4]
    assert len(a) == 1500 and all(b[i] == pytest.approx(v, abs=1e-9) for i, v in a.items())
    assert np.allclose(forest.importance(), whole.importance())
    forest.save(str(tmp_path))
    again = trees.Forest.load(spark, str(tmp_path), forest.meta())
    assert {r.id: r.prediction for r in again.transform(rows).collect()} == pytest.approx({i: v[0] for i, v in b.items()})
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(kept) if f.startswith("scratch-")]


def test_shuffle_files_go_with_their_action(spark):
    def held():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllBlocks()) if b.isShuffle()}

    before = held()
    with session.shuffles_dropped(spark):
        cut = session.cut_lineage(spark.range(5000).repartition(3, "id").groupBy("id").count())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and cut.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_bootstrap_weights_are_poisson():
    w = trees.bootstrap_weights(np.arange(200_000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w != trees.bootstrap_weights(np.arange(200_000), 4, 42)).mean() > 0.5


@pytest.mark.parametrize("name", ["decision_tree_classifier", "random_forest_classifier", "adaboost", "lda", "knn_classifier"])
def test_every_model_is_saved_and_scored_alike(spark, name, tmp_path):
    params = {"rounds": 10} if name == "adaboost" else {"numTrees": 10} if name.startswith("random") else {}
    t = models.train(blobs(spark), "id", ["a", "b"], "colour", name, **params)
    assert t.metrics.first()["accuracy"] > 0.97
    t.save(str(tmp_path))
    again = models.Trained.load(spark, str(tmp_path))
    a, b = t.score(blobs(spark)).orderBy("id").collect(), again.score(blobs(spark)).orderBy("id").collect()
    assert a == b and len(a) == 300
    if name == "knn_classifier":
        with pytest.raises(ValueError):
            models.feature_importance(again)
    else:
        assert sum(a[0]["probabilities"].values()) == pytest.approx(1.0)
        assert models.feature_importance(again).count() == 2


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_queries_are_voted_on_in_slices(spark, monkeypatch, weights):
    # The steps of a slice leave nothing on disk for the next one, and votes are those of one search of all.
    donors, _ = cloud(spark, 600, 3, 1, 0.2)
    donors = donors.union(donors.where("id < 20")).withColumn("label", (F.col("id") % 3).cast("double"))
    queries, _ = cloud(spark, 150, 3, 2)
    queries = queries.union(donors.where("id < 5").select(F.lit(None).cast("bigint"), "x"))
    near = neighbors.nearest_join(queries, donors.select("id", "x"), 4)
    want = {r["id"]: r["prediction"] for r in neighbors._votes(near, donors, "label", weights).collect()}
    asked, search = [], neighbors._RegionIndex.candidates

    def noted(self, own, keep):
        kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        folder = next(f"{kept}/{f}" for f in os.listdir(kept) if f.startswith("scratch-"))
        asked.append((own.count(), sum(f.isdigit() for f in os.listdir(folder))))
        return search(self, own, keep)

    monkeypatch.setattr(neighbors, "BLOCK", 40)
    monkeypatch.setattr(neighbors, "SLICE_ROWS", 60)
    monkeypatch.setattr(neighbors._RegionIndex, "candidates", noted)
    got = neighbors.classify_nearest(donors, queries, "label", 4, weights)
    assert {r["id"]: r["prediction"] for r in got.collect()} == want and len(want) == 151
    assert len(asked) == 3 and sum(n for n, _ in asked) == queries.count()
    assert {tables for _, tables in asked} == {2}
