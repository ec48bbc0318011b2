"""Training, search, scoring and curve queries over all events or lines."""

from pyspark.sql import functions as F

from tablewright.operators import explain as x
from tablewright.operators import learn as ml
from tablewright.plans.counts import categories
from tablewright.plans.durable import scratch_path
from tablewright.plans.types import rounded
from tablewright.workload.fragments import r
from tablewright.workload.registry import query

# is the event worth a follow-up?  value and k decide, the kind blurs the border
LEADS = """SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k, event_type AS kind, user_id,
    CASE WHEN value + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 2 + length(event_type) * 6 > 110 THEN 'yes' ELSE 'no' END AS follow_up FROM events"""
# three tiers of the same
TIERS = """SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k, event_type AS kind,
    CASE WHEN value + length(event_type) * 4 > 110 THEN 'high' WHEN value > 40 THEN 'middle' ELSE 'low' END AS tier FROM events"""
PRICES = """SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k, event_type AS kind,
    value * 3 + length(event_type) * 10 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS price FROM events"""


def leads(t):
    return ml.prepare(t.sql(LEADS, "events"), "follow_up", ["event_id"], ["value", "k", "kind"])


def tiers(t):
    return ml.prepare(t.sql(TIERS, "events"), "tier", ["event_id"], ["value", "k", "kind"])


def prices(t):
    return ml.prepare(t.sql(PRICES, "events"), "price", ["event_id"], ["value", "k", "kind"], task="regression")


def fitted(name, make, model, params):
    @query(name)
    def _(t):
        data = make(t)
        return ml.predictions(data, ml.fit(data, model, params))


fitted("fit_logistic", leads, "LogisticRegression", {"C": 1})
fitted("fit_logistic_classes", tiers, "LogisticRegression", {"C": 1})
fitted("fit_random_forest", tiers, "RandomForest", {"n_estimators": 50, "max_depth": 6})
fitted("fit_random_forest_values", prices, "RandomForest", {"n_estimators": 50, "max_depth": 6})
fitted("fit_gbt", leads, "GradientBoosting", {"n_estimators": 50, "max_depth": 3})
fitted("fit_gbt_classes", tiers, "GradientBoosting", {"n_estimators": 50, "max_depth": 3})
fitted("fit_gbt_values", prices, "GradientBoosting", {"n_estimators": 50, "max_depth": 3})
fitted("fit_decision_tree", tiers, "DecisionTree", {"max_depth": 8, "min_samples_split": 5})
fitted("fit_decision_tree_values", prices, "DecisionTree", {"max_depth": 8})
fitted("fit_linear_svm", leads, "LinearSVM", {"C": 1})
fitted("fit_linear_svm_classes", tiers, "LinearSVM", {"C": 0.1})

# Gaussian classes have a closed form, and so has a line through one feature
BAYES = "SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k, event_type FROM events"


def _bayes(smoothing):
    return f"""WITH t AS ({BAYES}), e AS (SELECT {smoothing} * greatest(var_pop(value), var_pop(k)) AS eps FROM t),
    c AS (SELECT event_type AS label, ln(count(*) / (SELECT count(*) FROM t)) AS prior, avg(value) AS m1, var_pop(value) + any_value(eps) AS v1, avg(k) AS m2, var_pop(k) + any_value(eps) AS v2 FROM t, e GROUP BY event_type),
    s AS (SELECT event_id, label, prior - 0.5 * (ln(v1) + power(value - m1, 2) / v1 + ln(v2) + power(k - m2, 2) / v2) AS score FROM t, c)
    SELECT event_id, arg_max(label, score) AS prediction FROM s GROUP BY event_id"""


def _bayes_predictions(t, smoothing):
    from pyspark.ml.feature import VectorAssembler

    df = t.sql(BAYES, "events")
    classes = categories(df, "event_type", 100)
    rows = df.withColumn("label", ml.label_column(df, "event_type", classes))
    vectors = VectorAssembler(inputCols=["value", "k"], outputCol="features").transform(rows)
    model = ml.estimator("NaiveBayes", "classification", df.count(), len(classes), {"var_smoothing": smoothing}).fit(vectors)
    names = F.array(*[F.lit(c) for c in classes])
    return model.transform(vectors).select("event_id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"))


@query("fit_naive_bayes", _bayes("1e-9"))
def _(t):
    return _bayes_predictions(t, 1e-9)


@query("fit_naive_bayes_smoothed", _bayes("0.5"))
def _(t):
    return _bayes_predictions(t, 0.5)


LINE = "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem"


def line(name, model, params, slope):
    @query(
        name,
        f"""WITH s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, count(*) AS n FROM ({LINE})),
        w AS (SELECT *, {slope} AS slope FROM s) SELECT {r('slope', 3)} AS slope, {r('my - slope * mx', 2)} AS intercept FROM w""",
    )
    def _(t):
        from pyspark.ml.feature import VectorAssembler

        df = t.sql(LINE, "lineitem").withColumnRenamed("y", "label")
        vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
        rows, std = df.agg(F.count("*"), F.stddev_pop("label")).first()
        fit = ml.estimator(model, "regression", rows, params=params, label_std=std).fit(vectors)
        return t("lineitem").agg(
            rounded(F.max(F.lit(float(fit.coefficients[0]))), 3).alias("slope"), rounded(F.max(F.lit(float(fit.intercept))), 2).alias("intercept")
        )


line("fit_linear", "Linear", {}, "sxy / sxx")
line("fit_ridge", "Ridge", {"alpha": 100000}, "sxy / (sxx + 100000)")
line("fit_lasso", "Lasso", {"alpha": 10}, "sign(sxy) * greatest(abs(sxy) - 10 * n, 0) / sxx")


VECTORS = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS point, label FROM embeddings"
_IS_TEST = "row_number() OVER (ORDER BY substr(md5('42|' || id), 1, 13), id) <= ceil(0.2 * count(*) OVER ())"


def _knn(k, weight, answer):
    return f"""WITH t AS (SELECT *, {_IS_TEST} AS is_test FROM ({VECTORS})),
    d AS (SELECT a.id AS test_id, b.id AS train_id, b.label AS label, list_distance(a.point, b.point) AS distance FROM t a JOIN t b ON a.is_test AND NOT b.is_test),
    n AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) AS place FROM d),
    w AS (SELECT test_id, label, {weight} AS w FROM n WHERE place <= {k}) {answer}"""


def _points(t):
    from tablewright.operators.prep import split_random

    points = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"), "label")
    split = split_random(points, ["id"])
    return split.where(~F.col("is_test")), split.where("is_test")


@query(
    "predict_knn",
    _knn(7, "1", """, v AS (SELECT test_id, label, sum(w) AS w FROM w GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY w DESC, label) AS at_ FROM v) SELECT test_id, label AS prediction FROM o WHERE at_ = 1"""),
)
def _(t):
    return ml.predict_knn(*_points(t), k=7)


@query(
    "fit_knn",
    _knn(5, "1 / distance", """, v AS (SELECT test_id, label, sum(w) AS w FROM w GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY w DESC, label) AS at_, sum(w) OVER (PARTITION BY test_id) AS whole FROM v)
    SELECT test_id, CAST(label AS DOUBLE) AS prediction, round(w / whole, 6) AS confidence FROM o WHERE at_ = 1"""),
)
def _(t):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    train, test = (side.select("id", array_to_vector("point").alias("features"), "label") for side in _points(t))
    classes = train.agg(F.max("label")).first()[0] + 1
    model = ml.estimator("KNN", "classification", 1, classes, {"n_neighbors": 5, "weights": "distance"}).fit(train)
    found = model.transform(test)
    return found.select(F.col("id").alias("test_id"), "prediction", rounded(F.array_max(vector_to_array("probability"))).alias("confidence"))


@query("knn_search")
def _(t):
    data = leads(t)
    return ml.tried_frame(data, ml.grid_search(data, "KNN"))


@query("bayes_range_search")
def _(t):
    data = tiers(t)
    return ml.tried_frame(data, ml.range_search(data, "NaiveBayes", 10))


@query("predict_knn_distance", _knn(5, "1 / distance", f"SELECT test_id, {r('sum(w * label) / sum(w)')} AS prediction FROM w GROUP BY test_id"))
def _(t):
    df = ml.predict_knn(*_points(t), k=5, task="regression", weights="distance")
    return df.withColumn("prediction", rounded(F.col("prediction")))


@query("grid_search")
def _(t):
    data = leads(t)
    return ml.tried_frame(data, ml.grid_search(data, "LogisticRegression"))


@query("random_search")
def _(t):
    data = leads(t)
    return ml.tried_frame(data, ml.random_search(data, "DecisionTree", 8))


@query("search_fold_scores")
def _(t):
    data = tiers(t)
    scores = ml.fold_scores(data, "DecisionTree", {"max_depth": 5})
    return t.spark.createDataFrame(list(enumerate(scores)), "fold int, score double")


@query("train_ranked")
def _(t):
    return ml.train_ranked(leads(t))[0]


@query("train_ranked_values")
def _(t):
    grids = {"Linear": {}, "Ridge": {"alpha": [0.1, 10]}, "Lasso": {"alpha": [0.01, 1]}, "DecisionTree": {"max_depth": [5]}}
    return ml.train_ranked(prices(t), list(grids), 2, grids)[0]


@query("baseline_vs_optimized")
def _(t):
    return ml.baseline_and_optimized(leads(t), "DecisionTree", {"max_depth": 2}, 8, {"max_depth": [4, 6, 8, 10], "min_samples_split": [2, 5, 10]})


_RESULTS = "SELECT concat(p_brand, ' ', p_type) AS model, CASE WHEN max(p_size) > 45 THEN round(avg(p_retailprice), 4) END AS score FROM part GROUP BY p_brand, p_type"


@query("model_leaderboard", f"SELECT model, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, model) AS INTEGER) AS place FROM ({_RESULTS})")
def _(t):
    return ml.leaderboard(t.sql(_RESULTS, "part"), "score", "model")


@query("batch_score")
def _(t):
    data = leads(t)
    path = scratch_path(t.spark, "model")
    ml.save(path, ml.fit(data, "LogisticRegression"), data, {"note": "follow-up"})
    model, prep, meta = ml.load(t.spark, path)
    return ml.batch_score(t.sql(LEADS, "events").drop("follow_up"), ["event_id"], model, prep, meta["classes"])


@query("learning_curve")
def _(t):
    return ml.learning_curve(leads(t), "DecisionTree", {"max_depth": 5}, sizes=5)


@query("validation_curve")
def _(t):
    return ml.validation_curve(leads(t), "DecisionTree", "max_depth")


@query("compare_models")
def _(t):
    data = leads(t)
    models = {n: ml.fit(data, n, p) for n, p in (("LogisticRegression", {}), ("DecisionTree", {"max_depth": 5}), ("NaiveBayes", {}))}
    return ml.compare(data, models)


@query("evaluate_dataset")
def _(t):
    df = t.sql(LEADS, "events").select("event_id", "value", "k", "kind", "follow_up")
    models = {"LogisticRegression": {}, "RandomForest": {"n_estimators": 50, "max_depth": 5}, "GradientBoosting": {"n_estimators": 50}, "DecisionTree": {"max_depth": 8}}
    return ml.evaluate_dataset(df, ["event_id"], models=models)[0]


@query("feature_importance")
def _(t):
    data = tiers(t)
    model = ml.fit(data, "RandomForest", {"n_estimators": 50, "max_depth": 5})
    return x.feature_importance(data.train, model, data.names)


def _line_model(t):
    data = prices(t)
    return data, ml.fit(data, "Linear")


@query("permutation_attribution")
def _(t):
    data, model = _line_model(t)
    rows = data.preparation.transform(t.sql(PRICES, "events"), ["event_id"])
    signs = dict(zip(data.names, [float(c) for c in model.coefficients]))
    return x.permutation_attribution(rows, model, data.names, "event_id", signs)


@query(
    "local_attribution",
    f"""WITH t AS ({PRICES}), s AS (SELECT regr_slope(price, value) AS slope FROM t)
    SELECT event_id AS key, 'value' AS feature, {r('slope * (value - 50)', 4)} AS attribution FROM t, s""",
)
def _(t):
    from pyspark.ml.feature import VectorAssembler

    df = t.sql(PRICES, "events")
    vectors = VectorAssembler(inputCols=["value"], outputCol="features").transform(df.withColumnRenamed("price", "label"))
    model = ml.estimator("Linear", "regression", df.count()).fit(vectors)
    out = x.local_attribution(df, model, ["value"], "event_id", {"value": 50.0})
    return out.withColumn("attribution", rounded(F.col("attribution"), 4))


@query("local_attribution_features")
def _(t):
    data, model = _line_model(t)
    rows = data.preparation.transform(t.sql(PRICES, "events"), ["event_id"])
    return x.local_attribution(rows, model, data.names, "event_id", {c: 0.0 for c in data.names})


SKEWED = "SELECT event_id, CASE WHEN value > 150 THEN 'rare' ELSE 'common' END AS label, value, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k FROM events"


@query(
    "balance_oversample_counts",
    f"SELECT label, max(count(*)) OVER () AS n FROM ({SKEWED}) GROUP BY label",
)
def _(t):
    df = ml.oversample(t.sql(SKEWED, "events"), "label", "event_id", ["value", "k"])
    return df.groupBy("label").agg(F.count("*").alias("n"))


@query("balance_oversample")
def _(t):
    return ml.oversample(t.sql(SKEWED, "events"), "label", "event_id", ["value", "k"])

