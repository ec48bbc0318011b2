"""Clustering queries over all embeddings (their labels as given clusters) and over events as plane points."""

from pyspark.sql import functions as F

from tablewright.operators import cluster as c
from tablewright.operators.density import dbscan
from tablewright.operators.metric import dbscan_search
from tablewright.plans.types import rounded
from tablewright.workload.fragments import r
from tablewright.workload.registry import query

V = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS point, label AS cluster FROM embeddings)"


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"), F.col("label").alias("cluster"))


def fitted(name, kind, numbers):
    @query(name)
    def _(t):
        return c.fit_best(vectors(t).drop("cluster"), kind, numbers)[0]


fitted("cluster_kmeans", "kmeans", range(2, 9))
fitted("cluster_gmm", "gmm", range(2, 9))
fitted("cluster_hierarchical", "hierarchical", range(2, 9))


@query("cluster_scores")
def _(t):
    return c.fit_best(vectors(t).drop("cluster"), "kmeans", range(2, 9))[1]


@query("cluster_spectral")
def _(t):
    return c.spectral(vectors(t).drop("cluster"), 4)


@query("cluster_dbscan")
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    points = t("events").select(F.col("event_id").alias("id"), F.array(F.col("value"), k).alias("point"))
    return dbscan(points, 2.0, 6)


def _density(eps, counts):
    cases = ", ".join(f"({e}e0, {m})" for e in eps for m in counts)
    return f"""WITH RECURSIVE {V[5:]}, g AS (SELECT * FROM (VALUES {cases}) AS g(eps, m)),
    d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.point, b.point) AS d FROM v a JOIN v b ON TRUE),
    c AS MATERIALIZED (SELECT eps, m, a AS id FROM d JOIN g ON d <= eps GROUP BY eps, m, a HAVING count(*) >= m),
    k AS MATERIALIZED (SELECT c.eps, c.m, a, b FROM d JOIN c ON c.id = d.a AND d <= c.eps JOIN c o ON o.id = d.b AND o.eps = c.eps AND o.m = c.m),
    w AS (SELECT eps, m, id, id AS root FROM c UNION SELECT k.eps, k.m, k.b, w.root FROM w JOIN k ON k.eps = w.eps AND k.m = w.m AND k.a = w.id),
    t AS (SELECT eps, m, id, min(root) AS root FROM w GROUP BY ALL),
    n AS MATERIALIZED (SELECT eps, m, id, dense_rank() OVER (PARTITION BY eps, m ORDER BY root) - 1 AS cluster FROM t),
    b AS (SELECT g.eps, g.m, d.a AS id, min(n.cluster) AS cluster FROM d JOIN g ON d <= eps JOIN n ON n.eps = g.eps AND n.m = g.m AND n.id = d.b GROUP BY ALL),
    l AS MATERIALIZED (SELECT g.eps, g.m, v.id, CAST(coalesce(n.cluster, b.cluster, -1) AS INTEGER) AS cluster FROM g JOIN v ON TRUE
      LEFT JOIN n ON n.eps = g.eps AND n.m = g.m AND n.id = v.id LEFT JOIN b ON b.eps = g.eps AND b.m = g.m AND b.id = v.id)"""


@query("cluster_dbscan_wide", _density([1.14], [3]) + " SELECT id, cluster FROM l")
def _(t):
    return dbscan(vectors(t).drop("cluster"), 1.14, 3)


_RADII, _COUNTS = [1.1, 1.12, 1.14], [2, 3, 5]


@query(
    "dbscan_search",
    _density(_RADII, _COUNTS) + f""", z AS (SELECT eps, m, cluster, count(*) AS n FROM l GROUP BY ALL),
    p AS (SELECT x.eps, x.m, x.id, x.cluster AS ca, y.cluster AS cb, sum(d * d) AS s FROM l x JOIN d ON d.a = x.id JOIN l y ON y.id = d.b AND y.eps = x.eps AND y.m = x.m GROUP BY ALL),
    q AS (SELECT p.eps, p.m, id, max(CASE WHEN ca = cb THEN s / (n - 1) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b, max(CASE WHEN ca = cb THEN n END) AS n
      FROM p JOIN z ON z.eps = p.eps AND z.m = p.m AND z.cluster = cb GROUP BY p.eps, p.m, id, ca),
    o AS (SELECT eps, m, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS score FROM q GROUP BY eps, m HAVING count(b) > 0),
    u AS (SELECT eps, m, count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS n_clusters, count(*) FILTER (WHERE cluster < 0) AS n_noise FROM l GROUP BY eps, m)
    SELECT u.eps, CAST(u.m AS INTEGER) AS min_samples, n_clusters, n_noise, {r('score')} AS silhouette_squared,
      row_number() OVER (ORDER BY score DESC NULLS LAST, u.eps, u.m) = 1 AS best FROM u LEFT JOIN o ON o.eps = u.eps AND o.m = u.m""",
)
def _(t):
    tried = dbscan_search(vectors(t).drop("cluster"), _RADII, _COUNTS, c.silhouette_squared)[1]
    return tried.withColumn("silhouette_squared", rounded(F.col("silhouette_squared")))


_PAIRS = """, n AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1),
    p AS (SELECT a.id AS id, a.cluster AS ca, b.cluster AS cb, sum({d}) AS s FROM v a JOIN v b ON TRUE GROUP BY ALL),
    m AS (SELECT id, ca, max(CASE WHEN ca = cb THEN s / (n - 1) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b, max(CASE WHEN ca = cb THEN n END) AS n
      FROM p JOIN n ON n.cluster = cb GROUP BY id, ca)"""


@query("silhouette", V + _PAIRS.format(d="list_distance(a.point, b.point)") + f" SELECT {r('avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette FROM m")
def _(t):
    return c.silhouette_rows(vectors(t)).agg(rounded(F.avg("silhouette")).alias("silhouette"))


@query("silhouette_squared", V + _PAIRS.format(d="list_distance(a.point, b.point) * list_distance(a.point, b.point)") + f" SELECT {r('avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette FROM m")
def _(t):
    return t("embeddings").agg(rounded(F.max(F.lit(c.silhouette_squared(vectors(t))))).alias("silhouette"))


_LONG = V + """, x AS (SELECT id, cluster, unnest(point) AS x, generate_subscripts(point, 1) AS i FROM v),
    m AS (SELECT cluster, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), w AS (SELECT i, avg(x) AS m FROM x GROUP BY i)"""


@query(
    "calinski_harabasz",
    _LONG + f""", b AS (SELECT sum(m.n * power(m.m - w.m, 2)) AS b FROM m JOIN w USING (i)), e AS (SELECT sum(power(x.x - m.m, 2)) AS e FROM x JOIN m USING (cluster, i)),
    k AS (SELECT count(DISTINCT cluster) AS k, count(*) AS n FROM v) SELECT {r('b / e * (n - k) / (k - 1)')} AS calinski_harabasz FROM b, e, k""",
)
def _(t):
    return c.calinski_harabasz(vectors(t)).select(rounded(F.col("calinski_harabasz")).alias("calinski_harabasz"))


@query(
    "davies_bouldin",
    _LONG + f""", d AS (SELECT id, cluster, sqrt(sum(power(x.x - m.m, 2))) AS d FROM x JOIN m USING (cluster, i) GROUP BY id, cluster), s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY cluster),
    g AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum(power(a.m - b.m, 2))) AS g FROM m a JOIN m b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY ALL),
    z AS (SELECT g.a, max((p.s + q.s) / g) AS worst FROM g JOIN s p ON p.cluster = g.a JOIN s q ON q.cluster = g.b GROUP BY g.a) SELECT {r('avg(worst)')} AS davies_bouldin FROM z""",
)
def _(t):
    return c.davies_bouldin(vectors(t)).select(rounded(F.col("davies_bouldin")).alias("davies_bouldin"))


@query("cluster_counts", "SELECT count(DISTINCT label) FILTER (WHERE label <> 0) AS n_clusters, count(*) FILTER (WHERE label = 0) AS n_noise FROM embeddings")
def _(t):
    df = vectors(t).withColumn("cluster", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")))
    return c.cluster_counts(df)


@query("ts_supervised")
def _(t):
    return c.supervised_series(t("events"), "value", ["ts", "event_id"])


@query("ts_supervised_past")
def _(t):
    return c.supervised_series(t("events"), "value", ["ts", "event_id"], "Ridge", {"alpha": 1.0}, exclude_current=True)
