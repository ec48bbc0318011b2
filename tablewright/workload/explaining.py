"""Explanation queries that need no model."""

from pyspark.sql import functions as F

from tablewright.operators import explain as x
from tablewright.plans.types import rounded
from tablewright.workload.evaluating import GUESSES
from tablewright.workload.fragments import per_column, r, union
from tablewright.workload.registry import query

_F = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "global_feature_stats",
    per_column(
        _F,
        lambda c: f"""SELECT '{c}' AS feature, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_pop({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, {r(f'max({c})', 4)} AS max,
        {r(f'max({c}) - min({c})', 4)} AS range, {r(f'stddev_pop({c}) / greatest(abs(avg({c})), 1e-10)', 4)} AS cv FROM lineitem""",
    ),
)
def _(t):
    df = x.feature_statistics(t("lineitem"), _F)
    return df.withColumns({c: rounded(F.col(c), 4) for c in df.columns if c != "feature"})


@query(
    "confidence_distribution",
    f"""WITH t AS (SELECT greatest(pa, pn, pr) AS c FROM ({GUESSES})) SELECT {r('avg(c)')} AS mean_confidence, {r('min(c)')} AS min_confidence, {r('max(c)')} AS max_confidence,
    {r('stddev_pop(c)')} AS std_confidence, count(*) FILTER (WHERE c < 0.6) AS low_confidence_count, count(*) AS total_predictions FROM t""",
)
def _(t):
    df = x.confidence(t.sql(GUESSES, "lineitem"), ["pa", "pn", "pr"])
    return df.withColumns({c: rounded(F.col(c)) for c in ("mean_confidence", "min_confidence", "max_confidence", "std_confidence")})


_PAIRS = "SELECT o_totalprice, o_custkey, o_totalprice * 2 + o_custkey * 10 AS mix, o_custkey * 3 - o_totalprice / 500 AS other, o_orderkey FROM orders"
_N = ["o_totalprice", "o_custkey", "mix", "other", "o_orderkey"]


@query(
    "feature_interactions",
    f"""WITH t AS ({_PAIRS}), c AS ({union(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 3)} AS r FROM t" for i, a in enumerate(_N) for b in _N[i + 1:])})
    SELECT *, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM c WHERE abs(r) > 0.3""",
)
def _(t):
    return x.feature_interactions(t.sql(_PAIRS, "orders"), _N)


_A = "SELECT p_brand AS feature, round(avg(l_discount) - 0.05e0, 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
_B = "SELECT p_brand AS feature, round(avg(l_tax) - 0.04e0, 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


@query(
    "explanation_agreement",
    f"""WITH a AS (SELECT * FROM ({_A}) ORDER BY abs(value) DESC, feature LIMIT 10), b AS (SELECT * FROM ({_B}) ORDER BY abs(value) DESC, feature LIMIT 10),
    s AS (SELECT round(count(*) / 10, 4) AS agreement FROM a JOIN b ON a.feature = b.feature AND (a.value >= 0) = (b.value >= 0))
    SELECT *, CASE WHEN agreement > 0.7 THEN 'high' WHEN agreement > 0.4 THEN 'moderate' ELSE 'low' END AS consistency FROM s""",
)
def _(t):
    return x.agreement(t.sql(_A, "lineitem", "part"), t.sql(_B, "lineitem", "part"))


_IMP = "SELECT CAST(l_suppkey AS VARCHAR(20)) AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY l_suppkey"


@query(
    "cumulative_importance",
    f"""WITH i AS ({_IMP}), c AS (SELECT row_number() OVER (ORDER BY importance DESC, feature) AS n, sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS s FROM i)
    SELECT min(n) FILTER (WHERE s >= 0.5) AS features_for_50pct, min(n) FILTER (WHERE s >= 0.9) AS features_for_90pct, count(*) AS total_features FROM c""",
)
def _(t):
    return x.cumulative_importance(t.sql(_IMP, "lineitem"))
