"""Splits, folds and leak-free preparation of training tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.operators.clean import clip, drop_constants, drop_high_cardinality, drop_ids, fences, label_codes
from tablewright.operators.profile import column_kinds
from tablewright.plans import ordered, wide
from tablewright.plans.counts import value_counts
from tablewright.plans.durable import durable
from tablewright.plans.grouped import entry, group_sizes, grouped_cuts, with_cuts
from tablewright.plans.ordered import join_back, row_numbers
from tablewright.plans.selection import first_rows_bound, order_statistics, quantiles
from tablewright.plans.types import epoch_micros, is_date, is_numeric, known, quoted, text_columns

SEED = 42
TEST_SHARE = 0.2
#: Classes that a model can name; splits, folds and weights take any number.
CLASS_LIMIT = 1000
#: Categories of a feature that are listed one by one; beyond, they live in a table only.
LISTED = 1000
#: Categories beyond which a feature takes its places in the feature vector from that table.
SPARSE_FROM = 50


def hash_position(keys: Sequence[str], seed: int = SEED) -> Column:
    """A reproducible place in [0, 2**52) for every row, from the md5 of the seed and its key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def split_random(df: DataFrame, keys: Sequence[str], share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * rows) rows, the first by the hash of their (unique) key."""
    place, rows = hash_position(keys, seed), df.count()
    k = math.ceil(round(share * rows, 9))
    return df.withColumn("is_test", first_rows_bound(df, [place, *[quoted(c) for c in keys]], k, rows))


def class_sizes(df: DataFrame, target: str, sizes: DataFrame | None = None) -> dict:
    """Rows per known class, in class order, for models that name their classes; more than ``CLASS_LIMIT`` are an error."""
    rows = (group_sizes(df, target) if sizes is None else sizes).limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"target {target!r} has more than {CLASS_LIMIT} classes")
    return {r["_g"]: r["_size"] for r in sorted(rows, key=lambda r: r["_g"])}


def _test_size(share: float) -> Column:
    """Test rows of a class of ``_size`` rows: the rounded share, at least one and never all."""
    n = F.col("_size")
    return F.least(F.greatest(F.floor(F.lit(share) * n + 0.5), F.lit(1)), n - 1).cast("bigint")


def can_stratify(sizes: DataFrame, share: float) -> bool:
    """Whether every class of (_g, _size) can have rows on both sides."""
    classes, least, total = sizes.agg(F.count("*"), F.min("_size"), F.sum("_size")).first()
    return classes > 1 and least > 1 and total * (1 - share) >= classes


def training_sizes(sizes: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """Sizes of the classes of (_g, _size) after a stratified split."""
    return sizes.withColumn("_size", F.col("_size") - _test_size(share))


def split_stratified(
    df: DataFrame, keys: Sequence[str], target: str, share: float = TEST_SHARE, seed: int = SEED, sizes: DataFrame | None = None
) -> DataFrame:
    """Add ``is_test`` with the share kept inside every class (at least one row of a class on each side).

    Falls back to :func:`split_random` when a class has a single row or the training side could not hold all
    classes.  Classes of any size and number are cut by hash value, then key; ``sizes`` are known (_g, _size).
    """
    sizes = group_sizes(df, target) if sizes is None else sizes
    if not can_stratify(sizes, share):
        return split_random(df, keys, share, seed)
    place = hash_position(keys, seed)
    cuts = grouped_cuts(df, target, place, keys, sizes.select("_g", (_test_size(share) - 1).alias("_rank"), "_size"))
    return with_cuts(df, target, cuts, {"is_test": F.coalesce(entry(place, keys) <= F.col("_cuts")[0], F.lit(False))})


def split_temporal(df: DataFrame, order_by: Sequence[str], share: float = TEST_SHARE) -> DataFrame:
    """Add ``is_test``: the first (1 - share) of the rows in the given order train, the rest test."""
    k = math.floor(round((1 - share) * df.count(), 9))
    order = [epoch_micros(quoted(c)) if is_date(df.schema[c].dataType) else quoted(c) for c in order_by]
    return df.withColumn("is_test", ~first_rows_bound(df, order, k))


def safe_folds(smallest: int | None, folds: int) -> int:
    return max(2, min(folds, 10, folds if smallest is None else smallest))


def assign_folds(
    df: DataFrame, keys: Sequence[str], folds: int = 5, target: str | None = None, seed: int = SEED, sizes: DataFrame | None = None
) -> DataFrame:
    """Add ``fold`` (0..k-1), balanced over the table or, with a target, inside every class.

    The number of folds is clamped to 2..10 and to the smallest class; ``sizes`` are known (_g, _size).
    """
    place = hash_position(keys, seed)
    if target is None:
        n = df.count()
        k = safe_folds(None, min(folds, n))
        cuts = [i * (n // k) + min(i, n % k) for i in range(1, k)]
        at = order_statistics(df, {"x": (place, [c - 1 for c in cuts])}, {"x": n})["x"]
        fold = F.size(F.filter(F.array(*[F.lit(v) for v in at]), lambda t: t < place))
        return df.withColumn("fold", fold.cast("int"))
    sizes = group_sizes(df, target) if sizes is None else sizes
    k = safe_folds(sizes.agg(F.min("_size")).first()[0], folds)
    n, i = F.col("_size"), F.col("_i")
    rank = i * F.floor(n / k) + F.least(i, n % k) - 1
    wanted = sizes.withColumn("_i", F.explode(F.array(*[F.lit(j).cast("bigint") for j in range(1, k)])))
    cuts = grouped_cuts(df, target, place, keys, wanted.select("_g", rank.alias("_rank"), "_size"))
    mine = entry(place, keys)
    fold = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda cut: cut < mine)).cast("int"))
    return with_cuts(df, target, cuts, {"fold": fold})


# --- fitted preparation -----------------------------------------------------------------------------


@dataclass
class Preparation:
    """What was learnt from the training rows: fill values, centres, spreads and categories.

    ``dictionary`` has (column_name, value, position from 0, cnt) of the text columns with more than ``SPARSE_FROM``
    categories; those with more than ``LISTED`` are in it alone.
    """

    numeric: dict[str, tuple[float, float, float]]  # column -> fill, centre, spread
    categorical: dict[str, tuple[object, list | None]]  # column -> fill, categories if they are listed
    dates: set[str] = field(default_factory=set)
    encoding: str = "one_hot"
    sizes: dict[str, int] = field(default_factory=dict)  # categories of the columns in the dictionary
    dictionary: DataFrame | None = None

    def size(self, column: str) -> int:
        values = self.categorical[column][1]
        return self.sizes[column] if values is None else len(values)

    @property
    def unlisted(self) -> list[str]:
        return [c for c, (_, values) in self.categorical.items() if values is None]

    @property
    def feature_names(self) -> list[str]:
        """Names of all places of the vector; categories that are not listed are named by their position."""
        names = list(self.numeric)
        for c, (_, values) in self.categorical.items():
            names += [f"{c}_{v}" for v in (range(self.sizes[c]) if values is None else values)] if self.encoding == "one_hot" else [c]
        return names

    def _filled(self, c: str) -> Column:
        return F.coalesce(quoted(c).cast("string"), F.lit(self.categorical[c][0]))

    def _numbers(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c, (fill, centre, spread) in self.numeric.items():
            value = F.coalesce(_numeric_value(df, c, c in self.dates), F.lit(fill))
            out[c] = (value - F.lit(centre)) / F.lit(spread)
        return out

    def _place(self, c: str) -> Column:
        """Position of the row's category from 0, null if it is unknown; from the list, or from the joined dictionary."""
        values = self.categorical[c][1]
        if values is None:
            return F.col(f"_p_{c}")
        place = F.array_position(F.array(*[F.lit(v) for v in values]), self._filled(c))
        return F.when(place > 0, place - 1)

    def feature_columns(self, df: DataFrame) -> list[Column]:
        out = [value.alias(c) for c, value in self._numbers(df).items()]
        for c, (_, values) in self.categorical.items():
            if self.encoding != "one_hot":
                out.append(F.coalesce(self._place(c), F.lit(-1)).cast("double").alias(c))  # unseen: -1
            elif values is None:
                out.append(sparse_vector([(self._place(c), F.lit(1.0))], self.sizes[c]).alias(c))
            else:
                out += [F.when(self._filled(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in values]
        return out

    def with_places(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Add ``_p_<column>``, the position of the row's category in the dictionary (null if unknown).

        A dictionary within the limits of a broadcast is looked up column by column.  Otherwise rows are numbered, one
        join takes all columns of a row to their positions, and these are folded back to the row.
        """
        if not columns:
            return df
        words = self.dictionary.where(F.col("column_name").isin(*columns))
        texts = {f"_t{i}": self._filled(c) for i, c in enumerate(columns)}
        rows = df.withColumns(texts)
        if sum(self.sizes[c] for c in columns) <= ordered.BROADCAST_ROWS:
            for i, c in enumerate(columns):
                mine = words.where(F.col("column_name") == c).select(F.col("value").alias(f"_t{i}"), F.col("position").alias(f"_p_{c}"), "cnt")
                rows = join_back(rows, mine, [f"_t{i}"], "cnt", how="left", size=self.sizes[c])
            return rows.drop(*texts)
        rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(t).alias("value")) for c, t in zip(columns, texts)])
        met = join_back(rows.select("_row", F.inline(pairs)), words.select("column_name", "value", "position", "cnt"), ["column_name", "value"], "cnt")
        folded = met.groupBy("_row").agg(*[F.max(F.when(F.col("column_name") == c, F.col("position"))).alias(f"_p_{c}") for c in columns])
        return rows.join(folded, "_row", "left").drop("_row", *texts)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The kept columns followed by one double column per feature; categories that are not listed share a sparse vector."""
        return self.with_places(df, self.unlisted).select(*[quoted(c) for c in keep], *self.feature_columns(df))

    def vectors(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The kept columns followed by one ``features`` vector.

        With a dictionary the vector is sparse and gets one entry per column, whatever the number of categories.
        """
        many = [c for c in self.categorical if self.size(c) > SPARSE_FROM] if self.encoding == "one_hot" else []
        if not many and not self.unlisted:
            named = [c.alias(f"_v{i}") for i, c in enumerate(self.feature_columns(df))]
            names = [f"_v{i}" for i in range(len(named))]
            return VectorAssembler(inputCols=names, outputCol="features").transform(df.select(*[quoted(c) for c in keep], *named)).drop(*names)
        joined = many if self.encoding == "one_hot" else self.unlisted
        entries, offset = [], 0
        for value in self._numbers(df).values():
            entries.append((F.lit(offset), value))
            offset += 1
        for c in self.categorical:
            place = F.col(f"_p_{c}") if c in joined else self._place(c)
            if self.encoding == "one_hot":
                entries.append((place + offset, F.lit(1.0)))
                offset += self.size(c)
            else:
                entries.append((F.lit(offset), F.coalesce(place, F.lit(-1)).cast("double")))
                offset += 1
        return self.with_places(df, joined).select(*[quoted(c) for c in keep], sparse_vector(entries, offset).alias("features"))


def sparse_vector(entries: Sequence[tuple[Column, Column]], size: int) -> Column:
    """A sparse vector of (index, value) entries in ascending order; null indices and zeros are left out.

    It is parsed from its fields: that needs no name for each place, which assembling would give it.
    """
    all_ = F.array(*[F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")) for i, v in entries])
    held = F.filter(all_, lambda e: e["i"].isNotNull() & (e["v"] != 0))
    fields = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), F.transform(held, lambda e: e["i"]).alias("indices"), F.transform(held, lambda e: e["v"]).alias("values")
    )
    return F.from_json(F.to_json(F.struct(fields.alias("vector"))), T.StructType([T.StructField("vector", VectorUDT())]))["vector"]


def first_place(vector: Column, value: float) -> Column:
    """Place from 1 of the first ``value`` (not zero) in a vector, 0 if there is none; a sparse vector is never filled up."""
    fields = F.unwrap_udt(vector)
    at = F.array_position(fields["values"], F.lit(value))
    sparse = F.coalesce(F.try_element_at(fields["indices"], F.nullif(at, F.lit(0)).cast("int")) + 1, F.lit(0))
    return F.when(fields["type"] == 0, sparse).otherwise(at).cast("bigint")


def _numeric_value(df: DataFrame, c: str, date: bool) -> Column:
    kind = df.schema[c].dataType
    if date:
        col = quoted(c) if is_date(kind) else F.try_to_timestamp(quoted(c))
        return epoch_micros(col) / 1e6
    if isinstance(kind, T.BooleanType):
        return quoted(c).cast("int").cast("double")
    return known(df, c).cast("double")


def fit_preparation(
    train: DataFrame,
    features: Sequence[str],
    encoding: str = "one_hot",
    scale: bool = True,
    drop_id_text: bool = True,
    rows: int | None = None,
) -> Preparation:
    """Learn medians, means, population deviations, modes and categories from ``train`` only.

    ``rows`` is a known bound of the training rows.
    """
    chosen = train.select(*[quoted(c) for c in features])
    if drop_id_text:
        chosen = drop_high_cardinality(chosen, rule="prep")
    kinds = column_kinds(chosen)
    dates = {c for c in chosen.columns if kinds[c] == "datetime"}
    plain = {
        f.name for f in chosen.schema if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType)
    }
    numbers = [c for c in chosen.columns if c in plain or c in dates]
    texts = [c for c in text_columns(chosen) if c not in dates]
    values = {c: _numeric_value(chosen, c, c in dates) for c in numbers}
    fills = {c: v[0] if v[0] is not None else 0.0 for c, v in quantiles(chosen, {c: (v, [0.5]) for c, v in values.items()}, at_most=rows).items()} if numbers else {}
    numeric = {}
    if numbers and scale:
        filled = {c: F.coalesce(values[c], F.lit(fills[c])) for c in numbers}
        got = wide.fetch(chosen, {f"{k}|{c}": f(v) for c, v in filled.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))})
        numeric = {c: (fills[c], got[f"m|{c}"], got[f"s|{c}"] or 1.0) for c in numbers}
    elif numbers:
        numeric = {c: (fills[c], 0.0, 1.0) for c in numbers}
    categorical, sizes, dictionary = _fit_categories(chosen, texts)
    return Preparation(numeric, categorical, dates, encoding, sizes, dictionary)


def _fit_categories(df: DataFrame, texts: Sequence[str]) -> tuple[dict, dict[str, int], DataFrame | None]:
    """Fill values and listed categories per column, sizes and dictionary of the columns with many."""
    if not texts:
        return {}, {}, None
    counts = durable(value_counts(df, texts))
    best = F.min(F.struct((-F.col("cnt")).alias("n"), F.col("value"))).alias("best")
    found = {r["column_name"]: r for r in counts.groupBy("column_name").agg(F.count("*").alias("n"), best).collect()}
    sizes = {c: found[c]["n"] for c in texts if c in found and found[c]["n"] > SPARSE_FROM}
    few = [c for c in texts if c in found and found[c]["n"] <= LISTED]
    listed: dict[str, list] = {c: [] for c in texts if c not in sizes or c in few}
    for r in counts.where(F.col("column_name").isin(*few)).collect() if few else []:  # at most LISTED values a column
        listed[r["column_name"]].append(r["value"])
    fills = {c: found[c]["best"]["value"] if c in found else "unknown" for c in texts}
    categorical = {c: (fills[c], sorted(listed[c]) if c in listed else None) for c in texts}
    if not sizes:
        return categorical, {}, None
    placed = row_numbers(counts.where(F.col("column_name").isin(*sizes)), ["value"], "position", partition_by=["column_name"], rows=sum(sizes.values()))
    return categorical, sizes, durable(placed.withColumn("position", F.col("position") - 1))


def engine_clean(
    df: DataFrame,
    target: str,
    keep: Sequence[str] = (),
    imputation: bool = True,
    dedupe: bool = True,
    outlier: bool = False,
    scaling: bool = True,
    one_hot: bool = True,
    drop_constant: bool = True,
    leakage: bool = True,
) -> tuple[DataFrame, Preparation]:
    """The one-call training preparation of a whole table; ``keep`` are key columns carried along."""
    out = durable(df.distinct()) if dedupe else df  # the steps below read it about ten times
    if not imputation:
        out = out.dropna()
    if leakage:
        ids = [c for c in out.columns if c not in drop_ids(out).columns and c not in keep and c != target]
        out = out.drop(*ids)
    features = [c for c in out.columns if c != target and c not in keep]
    if outlier:
        numbers = [c for c in features if is_numeric(out.schema[c].dataType)]
        limits = {c: lim for c, lim in fences(out, numbers).items() if lim[1] > lim[0]}
        capped = {c: clip(known(out, c).cast("double"), F.lit(a), F.lit(b)) for c, (a, b) in limits.items()}
        out = out.withColumns(capped)
    chosen = out.select(*[quoted(c) for c in features])
    if drop_constant:
        chosen = drop_constants(chosen)
    chosen = drop_high_cardinality(chosen, rule="engine")
    prep = fit_preparation(out, chosen.columns, "one_hot" if one_hot else "ordinal", scaling, drop_id_text=False)
    return prep.transform(out, [*keep, target]), prep


# --- labels, components, balance ---------------------------------------------------------------------


def label_map(df: DataFrame, target: str) -> DataFrame:
    """Rows (label, code): sorted distinct labels numbered from 0."""
    return label_codes(df, target).select(quoted(target).cast("string").alias("label"), "code")


def reconcile_labels(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Translate labels or codes into codes by the map; others raise.  A label that reads like a code wins."""
    mapping = durable(mapping.select("label", "code"))
    both = mapping.select("label", "code", F.lit(0).alias("rank")).unionByName(mapping.select(F.col("code").cast("string").alias("label"), "code", F.lit(1).alias("rank")))
    text = quoted(column).cast("string")
    counts = df.groupBy(text.alias("label")).agg(F.count("*").alias("cnt"))
    codes = both.groupBy("label").agg(F.min_by("code", "rank").alias("_code")).join(counts, "label").withColumnRenamed("label", "_label")
    joined = join_back(df.withColumn("_label", text), durable(codes), ["_label"], "cnt", how="left")
    message = F.concat(F.lit(f"label outside the map in {column}: "), F.col("_label"))
    code = F.when(F.col("_label").isNull(), F.lit(None)).otherwise(F.coalesce("_code", F.raise_error(message).cast("int")))
    return joined.select(*[code.alias(column) if c == column else quoted(c) for c in df.columns])


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    sizes = group_sizes(df, target)
    classes, total = sizes.agg(F.count("*"), F.sum("_size")).first()
    weights = sizes.withColumn("_weight", F.lit(float(total or 0)) / (F.lit(classes) * F.col("_size")))
    joined = join_back(df.withColumn("_g", known(df, target)), weights, ["_g"], "_size", how="left", size=classes)
    return joined.select(*[quoted(c) for c in df.columns], F.col("_weight").alias("weight"))


def pca_share(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Project on the fewest principal components that hold ``share`` of the variance."""
    means = wide.fetch(df, {c: F.avg(quoted(c)) for c in features})
    centred = df.select(*[quoted(c) for c in keep], *[(quoted(c) - F.lit(means[c])).alias(f"_f{i}") for i, c in enumerate(features)])
    inputs = [f"_f{i}" for i in range(len(features))]
    vectors = VectorAssembler(inputCols=inputs, outputCol="_v").transform(centred).drop(*inputs)
    model = PCA(k=len(features), inputCol="_v", outputCol="_pc").fit(vectors)
    explained = [float(v) for v in model.explainedVariance]
    k, reached = 0, 0.0
    while k < len(explained) and reached < share - 1e-12:
        reached += explained[k]
        k += 1
    scores = vector_to_array("_pc")
    out = model.transform(vectors).select(*[quoted(c) for c in keep], *[scores[i].alias(f"pc{i + 1}") for i in range(k)])
    return out, explained[:k]
