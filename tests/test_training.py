import numpy as np
import pytest
from frames import labelled, skewed
from pyspark.sql import functions as F

from tablewright.operators import blocks, cluster, density, detection, evaluate, learn, prep
from tablewright.operators.blocks import nearest
from tablewright.operators.series import series_features


def analysis(df, target="label", **kw):
    return detection.analyze_target(df, target, **kw).first()


def test_target_analysis(spark):
    assert analysis(labelled(spark, {"a": 60, "b": 60, "c": 60}))["safe_folds"] == 5
    short = analysis(labelled(spark, {"a": 10, "b": 40, "c": 3}))
    assert short["safe_folds"] == 3 and short["folds_adjusted"]
    assert analysis(labelled(spark, {"a": 30, "b": 20, "c": 1}))["blocked"]
    names = spark.createDataFrame([(float(i), f"product {i}") for i in range(200)], "feature double, product_name string")
    found = analysis(names, "product_name")
    assert found["high_cardinality"] and found["identifier_like"] and found["blocked"]
    values = spark.createDataFrame([(i / 7, i * 1.5 + 0.1) for i in range(220)], "cgpa double, package double")
    assert analysis(values, "package", folds=7)["safe_folds"] == 7


def test_target_and_task(spark):
    rows = [(f"u{i}", 20 + i, 1000.0 * i, "Yes" if i % 2 else "No") for i in range(30)]
    df = spark.createDataFrame(rows, "user_id string, age bigint, income double, target string")
    best = detection.target_scores(df).where("place = 1").first()
    assert best["column_name"] == "target" and best["confidence"] == "High"
    assert detection.target_scores(df).where("column_name = 'user_id'").first()["score"] < 0
    assert detection.task_type(df, "target") == "classification"
    assert detection.task_type(df.withColumn("price", F.col("income") + 0.5), "price") == "regression"


def test_constant_target_is_refused(spark):
    df = labelled(spark, {"a": 20})
    with pytest.raises(ValueError, match="target_varies"):
        detection.require_valid_target(df, "label")


def leaky(spark):
    rows = [(i, float(i), None if i % 5 == 0 else float(i * 2), "xy"[i % 2], i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "id bigint, num1 double, num2 double, cat1 string, target bigint")


def test_preparation_sees_training_rows_only(spark):
    split = prep.split_stratified(leaky(spark), ["id"], "target", 0.25)
    train = split.where("NOT is_test")
    assert train.count() == 30 and split.where("is_test").count() == 10
    fitted = prep.fit_preparation(train, ["num1", "num2", "cat1"])
    assert fitted.numeric["num2"][0] == pytest.approx(train.toPandas()["num2"].median())
    out = fitted.transform(split, ["id"]).toPandas()
    assert not out.isna().any().any() and list(out.columns) == ["id", "num1", "num2", "cat1_x", "cat1_y"]
    unseen = fitted.transform(split.withColumn("cat1", F.lit("new")), ["id"]).toPandas()
    assert unseen[["cat1_x", "cat1_y"]].to_numpy().sum() == 0


def test_splits_and_folds_with_small_limits(spark, small_limits):
    df = skewed(spark).withColumn("label", F.when(F.col("key") == 0, "hot").otherwise("cold"))
    split = prep.split_stratified(df, ["id"], "label").groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert all(abs(r["t"] - 0.2 * r["n"]) < 1 for r in split.collect())
    sizes = prep.assign_folds(df, ["id"], 4, "label").groupBy("label", "fold").count().collect()
    for label in ("hot", "cold"):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1
    late = prep.split_temporal(df, ["at", "id"]).where("is_test").toPandas()
    assert set(late["id"]) == set(df.toPandas().sort_values(["at", "id"]).tail(600)["id"])


def test_reconcile_labels(spark):
    df = spark.createDataFrame([("a", "0"), ("b", "b"), ("c", "2")], "y string, p string")
    mapping = prep.label_map(df, "y")
    assert [r["p"] for r in prep.reconcile_labels(df, "p", mapping).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="outside the map"):
        prep.reconcile_labels(df.withColumn("p", F.lit("zebra")), "p", mapping).collect()


def test_perfect_and_constant_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "y string, p string")
    got = evaluate.classification_metrics(df, "y", "p").first()
    assert (got["accuracy"], got["f1"], got["mcc"], got["cohen_kappa"]) == (1.0, 1.0, 1.0, 1.0)
    flat = evaluate.classification_metrics(df.withColumn("p", F.lit("a")), "y", "p").first()
    assert flat["mcc"] == 0.0 and flat["accuracy"] == pytest.approx(1 / 3)


def test_curves_with_small_limits(spark, small_limits):
    df = skewed(spark).withColumn("y", (F.col("key") == 0).cast("int"))
    p = df.toPandas()
    pos, neg = p[p.y == 1].tied.to_numpy(), p[p.y == 0].tied.to_numpy()
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "y", {1: "tied"}).first()["auc"] == pytest.approx(want)


def points(spark, n=400, d=2, seed=5):
    rng = np.random.default_rng(seed)
    m = np.vstack([rng.normal(0, 1, (n // 2, d)), rng.normal(6, 1.5, (n // 4, d)), np.repeat(rng.uniform(-10, 12, (n // 16, d)), 4, 0)])
    rows = [(i, [float(v) for v in p], i % 3) for i, p in enumerate(m)]
    return m, spark.createDataFrame(rows, "id bigint, point array<double>, label bigint")


def test_nearest_is_exact(spark, small_limits):
    m, df = points(spark, d=3)
    got = nearest(df, df.select("id", "point"), 4, same=True).toPandas()
    assert (got.groupby("test_id").size() == 4).all() and len(got) == 4 * len(m)
    gaps = np.sqrt(((m[:, None] - m[None, :]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    want = np.sort(gaps, axis=1)[:, :4]
    assert np.allclose(got.sort_values(["test_id", "place"])["distance"].to_numpy().reshape(-1, 4), want)


@pytest.mark.parametrize("width", [2, 64])
def test_own_cells_bound_the_search_and_ties_go_to_the_smaller_id(spark, small_limits, monkeypatch, width):
    rng = np.random.default_rng(3)
    m = np.round(rng.uniform(0, 40, (3000, width)), 1 if width > 2 else 0)  # a plane of 41 x 41 places: many ties
    train = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(m)], "id bigint, point array<double>, label bigint").repartition(4)
    asked = m[:200] + (0.0 if width > 2 else 0.5)
    test = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "id bigint, point array<double>")
    met, plain = [], blocks.Index._meet
    monkeypatch.setattr(blocks.Index, "_meet", lambda self, probes, *rest: (met.append((probes.count(), len(self.pivots))), plain(self, probes, *rest))[1])
    got = nearest(train, test, 6).orderBy("test_id", "place").toPandas()
    gaps = np.sqrt(((asked[:, None] - m[None, :]) ** 2).sum(-1))
    want = gaps.argsort(axis=1, kind="stable")[:, :6]
    assert (got["train_id"].to_numpy().reshape(-1, 6) == want).all()
    assert (got["label"] == got["train_id"] % 3).all()
    (home, cells), (more, _) = met
    assert home == 200
    if width == 2:  # the far ends of the cells alone let a point visit several times as many
        assert cells > 30 and more < 4 * 200


def test_silhouettes_meet_every_two_blocks_once(spark, small_limits, monkeypatch):
    rng = np.random.default_rng(6)
    m, group = rng.normal(size=(400, 16)), rng.integers(0, 3, 400)
    m[:40] = m[40:80]
    df = spark.createDataFrame([(i, p.tolist(), int(g)) for i, (p, g) in enumerate(zip(m, group))], "id bigint, point array<double>, cluster int")
    parts = blocks.block_sums(df.withColumnRenamed("cluster", "group"), [0, 1, 2], "id bigint, sums array<double>")
    at_most = int(np.ceil(400 / blocks.block_rows(400, 16)))
    assert at_most > 3 and parts.count() == 400 * at_most  # each row once a block, though two blocks share one task
    gaps = np.sqrt(((m[:, None] - m[None, :]) ** 2).sum(-1))
    sums = np.stack([gaps[:, group == g].sum(axis=1) for g in range(3)], axis=1)
    own, sizes = sums[np.arange(400), group] / (np.bincount(group)[group] - 1), np.bincount(group)
    means = sums / sizes
    means[np.arange(400), group] = np.inf
    want = (means.min(axis=1) - own) / np.maximum(means.min(axis=1), own)
    got = {r.id: r.silhouette for r in cluster.silhouette_rows(df).collect()}
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-10)


def test_fast_distances_keep_their_digits():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 20)) + 1e6  # far from the origin: a plain product would lose ten digits
    b = np.vstack([a[:100], a[100:200] + 1e-7, rng.normal(size=(100, 20)) + 1e6, np.full((1, 20), np.nan)])
    want = np.sqrt(((a[:, None] - b[None, :]) ** 2).sum(-1))
    assert np.allclose(blocks.distances(a, b)[:, :-1], want[:, :-1], rtol=1e-11, atol=0) and np.isnan(blocks.distances(a, b)[:, -1]).all()
    edge = float(want[7, 250])
    assert ((blocks.distances(a, b, [edge]) <= edge) == (want <= edge)).all()
    i, j, d = blocks.nearest_few(a, b, 3)
    assert (j.reshape(-1, 3) == want[:, :-1].argsort(axis=1, kind="stable")[:, :3]).all() and d[0] == 0


def brute_dbscan(m, eps, k):
    near = ((m[:, None] - m[None, :]) ** 2).sum(-1) <= eps * eps
    core, label = near.sum(1) >= k, np.full(len(m), -1)
    number = 0
    for i in range(len(m)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = number
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = number
                    todo.append(j)
            number += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return label


@pytest.mark.parametrize("eps,k", [(0.35, 4), (1.0, 5), (3.0, 10)])
def test_dbscan_is_exact(spark, small_limits, eps, k):
    m, df = points(spark)
    got = density.dbscan(df, eps, k).toPandas().sort_values("id")["cluster"].to_numpy()
    assert (got == brute_dbscan(m, eps, k)).all()


def test_silhouette_is_exact(spark, small_limits):
    m, df = points(spark, 160)
    df = df.withColumnRenamed("label", "cluster")
    got = cluster.silhouette_rows(df).toPandas().sort_values("id")["silhouette"].to_numpy()
    gaps = np.sqrt(((m[:, None] - m[None, :]) ** 2).sum(-1))
    c = np.arange(len(m)) % 3
    for i in range(0, len(m), 17):
        a = gaps[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(gaps[i, c == o].mean() for o in range(3) if o != c[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_oversample_balances(spark, small_limits):
    rows = [(i, "rare" if i < 40 else "common", float(i), float(i % 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, label string, a double, b double")
    out = learn.oversample(df, "label", "id", ["a", "b"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"rare": 260, "common": 260}
    made = out.where("copy > 0").toPandas()
    assert made["a"].between(0, 39).all() and (made["label"] == "rare").all()


def test_ranked_training_keeps_going_and_scores_all_rows(spark, tmp_path):
    rows = [(i, float(i % 20), float((i * 7) % 13), "yes" if (i % 20) + (i * 7) % 13 > 15 else "no") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, label string")
    data = learn.prepare(df, "label", ["id"], folds=2)
    board, found = learn.train_ranked(data, ["LogisticRegression", "Nonsense"], 1, {"LogisticRegression": {"C": [1]}, "Nonsense": {"x": [1]}})
    got = {r["model"]: r for r in board.collect()}
    assert got["LogisticRegression"]["place"] == 1 and got["Nonsense"]["error"] and got["Nonsense"]["test_score"] is None
    again = learn.train_ranked(data, ["LogisticRegression"], 1, {"LogisticRegression": {"C": [1]}})[0].first()
    assert again["test_score"] == got["LogisticRegression"]["test_score"]
    learn.save(str(tmp_path / "m"), found["LogisticRegression"].model, data)
    model, fitted, meta = learn.load(spark, str(tmp_path / "m"))
    scored = learn.batch_score(df.drop("label", "b").withColumn("extra", F.lit(1)), ["id"], model, fitted, meta["classes"]).toPandas()
    assert len(scored) == 300 and set(scored["prediction"]) <= {"yes", "no"} and scored["confidence"].between(0.5, 1).all()


def test_series_leak_switch(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(30)], "at bigint, y double")
    with_now = series_features(df, "y", ["at"]).toPandas().sort_values("at")
    past = series_features(df, "y", ["at"], exclude_current=True).toPandas().sort_values("at")
    assert list(with_now["at"]) == list(range(7, 30))
    assert with_now["rolling_mean_3"].iloc[0] == pytest.approx((25 + 36 + 49) / 3)
    assert past["rolling_mean_3"].iloc[0] == pytest.approx((16 + 25 + 36) / 3)
    with pytest.raises(ValueError):
        cluster.supervised_series(df.limit(10), "y", ["at"])


def test_fits_walk_pieces_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(learn, "MOST_ROWS_PER_TASK", 500)
    sizes = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(500 * (cores + 8)).coalesce(cores)  # a piece for every core, but pieces too large
    assert max(sizes(learn.spread(many))) <= 1000 and sum(sizes(learn.spread(many))) == many.count()
    hollow = spark.range(30_000).repartition(2 * cores, F.col("id") * 0)  # one piece holds all
    assert hollow.rdd.getNumPartitions() > cores and max(sizes(learn.spread(hollow))) < 30_000
    assert learn.spread(spark.range(0)).count() == 0


def test_ranked_training_tries_every_algorithm_and_its_whole_grid(spark, monkeypatch, tmp_path):
    from tablewright.workload.registry import QUERIES

    rows = [(i, i % 7, ["click", "view", "purchase"][i % 3], float(i * 37 % 150), f'{{"k": {i * 11 % 100}}}') for i in range(400)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    tried = {}

    def search(data, name, candidates, parallelism=4):
        tried[name] = list(candidates)
        return learn.Found(name, dict(candidates[0]), 0.0, learn.fit(data, "DecisionTree", {"max_depth": 2}), [])

    monkeypatch.setattr(learn, "search", search)
    board = QUERIES["train_ranked"](spark, str(tmp_path)).collect()
    assert {r["model"] for r in board} == set(learn.CLASSIFIERS) and not any(r["error"] for r in board)
    assert tried == {name: learn.combinations(learn.GRIDS[name]) for name in learn.CLASSIFIERS}
