"""Profiling, detection and quality queries."""

from pyspark.sql import functions as F

from tablewright.operators import detection as d
from tablewright.operators import profile as p
from tablewright.workload.fragments import (
    EVENT_VALUES, ITEM_NUMBERS, ITEM_TYPES, ITEMS, SHORT_COLUMNS, SHORT_ITEMS, SHORT_NUMBERS, fences, per_column, r, union,
)
from tablewright.workload.registry import query

T = f"WITH t AS ({ITEMS})"
S = f"WITH t AS ({SHORT_ITEMS})"
DISTINCT_ROWS = "g AS (SELECT *, count(*) AS n FROM t GROUP BY ALL)"


def items(t):
    return t.sql(ITEMS, "lineitem")


def short_items(t):
    return t.sql(SHORT_ITEMS, "lineitem")


def _profile_row(c):
    kind = "numeric" if c in ITEM_NUMBERS else "categorical"
    head = f"'{c}' AS column_name, '{ITEM_TYPES[c]}' AS dtype, '{kind}' AS kind, count(*) - count({c}) AS missing"
    if c in ITEM_NUMBERS:
        return f"""SELECT {head}, {r(f'avg({c})', 2)} AS mean, {r('any_value(f.med)', 2)} AS median, {r(f'min({c})', 2)} AS min,
            {r(f'max({c})', 2)} AS max, {r(f'stddev_samp({c})', 2)} AS std,
            count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper) AS outliers, CAST(NULL AS BIGINT) AS unique_values
            FROM t, {fences('t', c)} f"""
    return f"""SELECT {head}, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS min,
        CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS BIGINT) AS outliers,
        count(DISTINCT {c}) AS unique_values FROM t"""


@query("profile_columns", T + per_column(ITEM_TYPES, _profile_row))
def _(t):
    return p.profile_columns(items(t))


def _result_row(c):
    number = c in ITEM_NUMBERS
    m = lambda e: r(e, 4) if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, '{ITEM_TYPES[c]}' AS dtype, count(*) - count({c}) AS null_count,
        {r(f'(count(*) - count({c})) * 100.0 / count(*)', 2)} AS null_pct, count(DISTINCT {c}) AS unique_count,
        {r(f'count(DISTINCT {c}) * 100.0 / count(*)', 2)} AS unique_pct, count(*) - count(DISTINCT {c}) AS duplicate_count,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, {m(f'avg({c})')} AS mean_value,
        {m(f'quantile_cont({c}, 0.5)')} AS median_value, {m(f'stddev_samp({c})')} AS std_value FROM t"""


@query("profile_query", T + per_column(ITEM_TYPES, _result_row))
def _(t):
    return p.profile_result(items(t))


@query(
    "profile_query_summary",
    S + f""", {DISTINCT_ROWS} SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    CAST(sum(n * ({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in SHORT_COLUMNS)})) AS BIGINT) AS missing_cells,
    CAST(sum(n) * {len(SHORT_COLUMNS)} AS BIGINT) AS total_cells FROM g""",
)
def _(t):
    return p.result_summary(short_items(t))


_HOLES = " + ".join(f"count(*) - count({c})" for c in ITEM_TYPES)


@query(
    "detect_missing",
    T + f""", a AS (SELECT {_HOLES} AS total_missing, {r(f'({_HOLES}) * 100.0 / (count(*) * {len(ITEM_TYPES)})', 2)} AS total_pct FROM t),
    m AS ({per_column(ITEM_TYPES, lambda c: f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)', 2)} AS missing_pct FROM t")})
    SELECT m.*, a.*, CASE WHEN total_pct < 5 THEN 'low' WHEN total_pct < 20 THEN 'medium' ELSE 'high' END AS severity
    FROM m, a WHERE missing > 0""",
)
def _(t):
    return p.missing_report(items(t))


@query(
    "detect_duplicates",
    S + f""", {DISTINCT_ROWS} SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows,
    {r('sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n)', 2)} AS pct FROM g""",
)
def _(t):
    return p.duplicate_twins(short_items(t))


@query(
    "duplicate_sample",
    S + f""", {DISTINCT_ROWS} SELECT quantity, discount, tax, flag, status, n AS copies FROM g WHERE n > 1
    ORDER BY quantity NULLS FIRST, discount NULLS FIRST, tax NULLS FIRST, flag NULLS FIRST, status NULLS FIRST LIMIT 5""",
)
def _(t):
    return p.duplicate_sample(short_items(t))


_EXTRA = f"""{DISTINCT_ROWS}, x AS (SELECT CAST(sum(n - 1) AS BIGINT) AS extra_rows, {r('sum(n - 1) * 100.0 / sum(n)', 2)} AS pct FROM g)"""


@query(
    "duplicate_extra_rows",
    S + f", {_EXTRA} SELECT *, CASE WHEN pct < 1 THEN 'low' WHEN pct < 10 THEN 'medium' ELSE 'high' END AS severity FROM x",
)
def _(t):
    return p.duplicate_extras(short_items(t))


@query(
    "duplicate_extra_texts",
    f"""WITH t AS (SELECT text FROM documents), {_EXTRA} SELECT *,
    CASE WHEN pct < 1 THEN 'low' WHEN pct < 10 THEN 'medium' ELSE 'high' END AS severity FROM x""",
)
def _(t):
    return p.duplicate_extras(t("documents").select("text"))


E_ = f"WITH t AS ({EVENT_VALUES})"


def _outlier_row(c):
    return f"""SELECT '{c}' AS column_name, {r('any_value(f.lo)', 4)} AS min, {r('any_value(f.q1)', 4)} AS q1,
        {r('any_value(f.med)', 4)} AS median, {r('any_value(f.q3)', 4)} AS q3, {r('any_value(f.hi)', 4)} AS max,
        {r('any_value(f.q3 - f.q1)', 4)} AS iqr, {r('any_value(f.lower)', 4)} AS lower, {r('any_value(f.upper)', 4)} AS upper,
        count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper) AS outliers_iqr,
        count(*) FILTER (WHERE abs({c} - f.mean) / f.std > 3) AS outliers_zscore,
        {r(f'count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper) * 100.0 / count(*)', 2)} AS outlier_pct
        FROM t, {fences('t', c)} f"""


@query("detect_outliers", E_ + per_column(["value", "squared", "user_id"], _outlier_row))
def _(t):
    return p.outlier_report(t.sql(EVENT_VALUES, "events"), ["value", "squared", "user_id"])


def _outlier_short(c):
    hits = f"count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper)"
    return f"""SELECT '{c}' AS column_name, {hits} AS outliers, {r(f'{hits} * 100.0 / count({c})', 2)} AS pct,
        {r('any_value(f.lower)', 2)} AS lower_bound, {r('any_value(f.upper)', 2)} AS upper_bound
        FROM t, {fences('t', c)} f HAVING any_value(f.q3 - f.q1) > 0 AND count({c}) >= 4"""


@query(
    "outlier_summary",
    E_ + f", o AS ({per_column(['event_id', 'user_id', 'value', 'squared'], _outlier_short)}) SELECT *, {r('avg(pct) OVER ()', 2)} AS mean_pct FROM o",
)
def _(t):
    return p.outlier_summary(t.sql(EVENT_VALUES, "events"))


@query(
    "detect_encoding",
    f"""WITH u AS ({per_column(['p_name', 'p_brand', 'p_type'], lambda c: f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values FROM part")})
    SELECT *, CASE WHEN unique_values <= 20 THEN 'one_hot' ELSE 'label' END AS recommended FROM u WHERE unique_values BETWEEN 2 AND 100""",
)
def _(t):
    return p.encoding_candidates(t("part"))


@query(
    "detect_scaling",
    T + per_column(
        ITEM_NUMBERS,
        lambda c: f"""SELECT '{c}' AS column_name, {r(f'min({c})', 4)} AS min, {r(f'max({c})', 4)} AS max, {r(f'avg({c})', 4)} AS mean,
        {r(f'stddev_samp({c})', 4)} AS std, {r(f'quantile_cont({c}, 0.5)', 4)} AS median,
        {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)', 4)} AS iqr, min({c}) = max({c}) AS constant FROM t""",
    ),
)
def _(t):
    return p.scaling_candidates(items(t))


_NUM = list(ITEM_NUMBERS)
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


def _corr(source):
    return union(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 3)} AS r FROM {source}" for a, b in _PAIRS)


@query("correlation_matrix", T + _corr("t"))
def _(t):
    return p.correlations(items(t))


@query("top_correlations", T + f", c AS ({_corr('t')}) SELECT * FROM c ORDER BY abs(r) DESC, x, y LIMIT 20")
def _(t):
    return p.top_correlations(items(t))


def _histogram(table, column, width_sql):
    return f"""WITH s AS (SELECT count({column}) AS n, CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi,
      quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25) AS iqr FROM {table}),
    k AS (SELECT *, CAST({width_sql} AS INTEGER) AS bins FROM s),
    w AS (SELECT *, (hi - lo) / bins AS width FROM k),
    h AS (SELECT least(CAST(floor(({column} - lo) / width) AS INTEGER), bins - 1) AS bin, count(*) AS cnt FROM {table}, w GROUP BY 1),
    b AS (SELECT CAST(unnest(range(bins)) AS INTEGER) AS bin, lo, width FROM w)
    SELECT b.bin AS bin, {r('lo + b.bin * width', 4)} AS bin_start, {r('lo + (b.bin + 1) * width', 4)} AS bin_end, coalesce(cnt, 0) AS cnt
    FROM b LEFT JOIN h ON b.bin = h.bin"""


_AUTO = """ceil((hi - lo) / least((hi - lo) / (log2(n) + 1),
    greatest(2 * iqr / power(n, 1.0 / 3), (hi - lo) / (2 * sqrt(n)))))"""


@query("histogram_auto", _histogram("events", "value", _AUTO))
def _(t):
    return p.histogram(t("events"), "value")


@query("histogram_fixed", _histogram("orders", "o_totalprice", "25"))
def _(t):
    return p.histogram(t("orders"), "o_totalprice", 25)


_ROLE_COLUMNS = {
    "event_id": "CASE WHEN u = n THEN 'id' WHEN u <= 10 THEN 'categorical' ELSE 'numeric' END",
    "ts": "'datetime'",
    "user_id": "CASE WHEN u = n THEN 'id' WHEN u <= 10 THEN 'categorical' ELSE 'numeric' END",
    "event_type": "'categorical'",
    "value": "CASE WHEN u <= 10 THEN 'categorical' ELSE 'numeric' END",
    "props": "CASE WHEN u > 30 AND len > 50 THEN 'text' ELSE 'categorical' END",
}


@query(
    "feature_roles",
    per_column(
        _ROLE_COLUMNS,
        lambda c: f"""SELECT '{c}' AS column_name, CASE WHEN u = 2 AND '{c}' <> 'ts' THEN 'boolean' ELSE {_ROLE_COLUMNS[c]} END AS role, u AS unique_values
        FROM (SELECT count(DISTINCT {c}) AS u, count({c}) AS n, avg(length(CAST({c} AS VARCHAR))) AS len FROM events)""",
    ),
)
def _(t):
    return p.feature_roles(t("events"))


def _share(table, column):
    return f"""s AS (SELECT {column} AS label, count(*) AS cnt, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 2)} AS pct
    FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)"""


def _imbalance(table, column):
    return f"""{_share(table, column)}, i AS (SELECT count(*) AS classes,
    {r('CASE WHEN min(pct) > 0 THEN max(pct) / min(pct) ELSE 99 END', 2)} AS imbalance_ratio FROM s),
    b AS (SELECT *, CASE WHEN imbalance_ratio < 2 THEN 'low' WHEN imbalance_ratio < 5 THEN 'medium' ELSE 'high' END AS severity FROM i)"""


@query("class_share", f"WITH {_share('documents', 'lang')} SELECT * FROM s")
def _(t):
    return p.class_share(t("documents"), "lang")


@query("class_imbalance", f"WITH {_imbalance('documents', 'lang')} SELECT * FROM b")
def _(t):
    return p.class_imbalance(t("documents"), "lang")


_SHORT_OUT = union(
    f"""SELECT round(count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper) * 100.0 / count({c}), 2) AS pct
    FROM t, {fences('t', c)} f HAVING any_value(f.q3 - f.q1) > 0"""
    for c in SHORT_NUMBERS
)
_SHORT_MISSING = " + ".join(f"count(*) - count({c})" for c in SHORT_COLUMNS)


@query(
    "quality_score",
    S + f""", {_EXTRA}, {_imbalance('t', 'flag')}, o AS ({_SHORT_OUT}),
    c AS (SELECT greatest(0, 100 - round(({_SHORT_MISSING}) * 100.0 / (count(*) * {len(SHORT_COLUMNS)}), 2) * 2) AS missing_data FROM t),
    q AS (SELECT missing_data, greatest(0, 100 - x.pct * 5) AS duplicates,
      greatest(0, 100 - (SELECT round(avg(pct), 2) FROM o) * 2) AS outliers,
      CASE severity WHEN 'high' THEN 60.0 WHEN 'medium' THEN 80.0 ELSE 100.0 END AS class_balance FROM c, x, b),
    z AS (SELECT *, {r('(missing_data + duplicates + outliers + class_balance) / 4', 1)} AS total FROM q)
    SELECT {r('missing_data', 1)} AS missing_data, {r('duplicates', 1)} AS duplicates, {r('outliers', 1)} AS outliers,
      {r('class_balance', 1)} AS class_balance, total,
      CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 65 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END AS grade FROM z""",
)
def _(t):
    return p.quality_score(short_items(t), "flag")


def _quality_row(c):
    pct = f"count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper) * 100.0 / count(*)" if c in SHORT_NUMBERS else "0"
    source = f"t, {fences('t', c)} f" if c in SHORT_NUMBERS else "t"
    return f"""SELECT '{c}' AS column_name, CAST(round(greatest(0, least(100, 100 - 2 * ((count(*) - count({c})) * 100.0 / count(*)) - 2 * ({pct})))) AS BIGINT) AS score FROM {source}"""


@query(
    "column_quality",
    S + f""", q AS ({per_column(SHORT_COLUMNS, _quality_row)}) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B'
    WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM q""",
)
def _(t):
    return p.column_quality(short_items(t))


_MATRIX = """SELECT event_id, NULLIF(event_type, 'error') AS event_type, CASE WHEN value > 50 THEN value END AS value,
    CASE WHEN user_id < 50 THEN '' ELSE props END AS props FROM events"""


@query(
    "missing_matrix",
    f"""WITH t AS ({_MATRIX}) SELECT event_id, event_type IS NULL OR event_type = '' AS event_type, value IS NULL AS value,
    props IS NULL OR props = '' AS props FROM t ORDER BY event_id LIMIT 30""",
)
def _(t):
    return p.missing_matrix(t.sql(_MATRIX, "events"), ["event_id"])


_LEAK = """SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 0.19 + 5 AS vat, length(o_orderpriority) AS customer_id,
    o_orderstatus FROM orders"""


@query(
    "leakage_warnings",
    f"""WITH t AS ({_LEAK}), c AS ({per_column(['o_orderkey', 'o_custkey', 'vat', 'customer_id'], lambda c: f"SELECT '{c}' AS column_name, 'target_leakage' AS warning, {r(f'corr({c}, o_totalprice)', 3)} AS r, corr({c}, o_totalprice) AS raw FROM t")}),
    u AS ({per_column(['o_orderkey', 'o_custkey', 'vat', 'customer_id', 'o_orderstatus'], lambda c: f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS u, count(*) AS n FROM t")})
    SELECT column_name, warning, r FROM c WHERE abs(raw) > 0.95
    UNION ALL SELECT column_name, 'identifier', CAST(NULL AS DOUBLE) FROM u WHERE u = n OR regexp_matches(column_name, '(^id$|_id$|\\.id$|^index$)')""",
)
def _(t):
    return p.leakage_warnings(t.sql(_LEAK, "orders"), "o_totalprice")


@query(
    "cleaning_recommendations",
    S + f""", {_EXTRA}, {_imbalance('t', 'flag')}, o AS ({_SHORT_OUT}),
    m AS (SELECT {_SHORT_MISSING} AS holes, ({_SHORT_MISSING}) * 100.0 / (count(*) * {len(SHORT_COLUMNS)}) AS pct FROM t),
    u AS ({per_column(SHORT_COLUMNS, lambda c: f"SELECT '{c}' AS c, {'TRUE' if c in SHORT_NUMBERS else 'FALSE'} AS num, count(DISTINCT {c}) AS u FROM t")})
    SELECT 'impute_missing' AS action, CASE WHEN pct > 10 THEN 'high' ELSE 'medium' END AS priority, holes AS concerned FROM m WHERE holes > 0
    UNION ALL SELECT 'remove_duplicates', CASE WHEN pct > 5 THEN 'high' ELSE 'low' END, extra_rows FROM x WHERE extra_rows > 0
    UNION ALL SELECT 'remove_outliers', 'medium', count(*) FROM o WHERE pct > 5 HAVING count(*) > 0
    UNION ALL SELECT 'encode_categorical', 'medium', count(*) FROM u WHERE c <> 'flag' AND u <> 2 AND u <= CASE WHEN num THEN 10 ELSE 1000000 END HAVING count(*) > 0
    UNION ALL SELECT 'encode_target', 'high', CAST(1 AS BIGINT)
    UNION ALL SELECT 'handle_imbalance', 'high', classes FROM b WHERE severity <> 'low'
    UNION ALL SELECT 'scale_numeric', 'low', CAST({len(SHORT_NUMBERS)} AS BIGINT)""",
)
def _(t):
    return p.cleaning_recommendations(short_items(t), "flag")


_HINT_TYPES = {"event_id": 1, "ts": 0, "user_id": 1, "event_type": 0, "value": 1, "gap": 1, "one": 1}
_HINTED = """SELECT event_id, ts, user_id, event_type, value, CASE WHEN value > 100 THEN value END AS gap, 1 AS one FROM events"""


@query(
    "query_result_hints",
    f"""WITH t AS ({_HINTED}), u AS ({union(f"SELECT {i} AS i, '{c}' AS c, {bool(n)} AS num, count(DISTINCT {c}) * 100.0 / count(*) AS up, count(DISTINCT {c}) AS u, (count(*) - count({c})) * 100.0 / count(*) AS np FROM t" for i, (c, n) in enumerate(_HINT_TYPES.items()))}),
    h AS (
      SELECT 'high_missing' AS hint, string_agg(c, ',' ORDER BY i) AS columns FROM u WHERE np > 30
      UNION ALL SELECT 'target_candidates', string_agg(c, ',' ORDER BY i) FROM u WHERE num AND u > 2 AND np < 50
      UNION ALL SELECT 'high_cardinality', string_agg(c, ',' ORDER BY i) FROM u WHERE up > 90 AND np < 50
      UNION ALL SELECT 'interactions', string_agg(c, ',' ORDER BY i) FROM u WHERE num HAVING count(*) > 2
      UNION ALL SELECT 'large_result', CASE WHEN count(*) > 100000 THEN '*' END FROM t
      UNION ALL SELECT 'duplicate_rows', CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) THEN '*' END FROM t
      UNION ALL SELECT 'constant_columns', string_agg(c, ',' ORDER BY i) FROM u WHERE u <= 1
      UNION ALL SELECT 'encode_text', 'event_type'
      UNION ALL SELECT 'date_parts', 'ts'
      UNION ALL SELECT 'check_outliers', string_agg(c, ',' ORDER BY i) FROM u WHERE num AND np < 50
      UNION ALL SELECT 'check_correlation', string_agg(c, ',' ORDER BY i) FROM u WHERE num HAVING count(*) >= 2)
    SELECT * FROM h WHERE columns IS NOT NULL""",
)
def _(t):
    return p.result_hints(t.sql(_HINTED, "events"))


@query(
    "top_values",
    T + f""", c AS ({per_column(['flag', 'status', 'line'], lambda c: f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM t WHERE {c} IS NOT NULL GROUP BY {c}")}),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS position,
    count(*) OVER (PARTITION BY column_name) AS d FROM c) SELECT column_name, value, cnt, position FROM k WHERE d < 20 AND position <= 5""",
)
def _(t):
    return p.top_values(items(t), ["flag", "status", "line", "price"])
