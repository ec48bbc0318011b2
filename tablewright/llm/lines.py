"""Line de-duplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. The pages that hold a line, divided by the pages of the host, is the line's ratio; lines
above ``ratio`` on at least ``min_pages`` pages are boilerplate and go from all pages of that host.

Lines end at line feeds and are compared without the blanks around them; blank lines always stay. A line counts once
per page. Pages without a host form one host of their own. Null texts stay null, empty ones empty. Repeated rows count
as pages of their own, unless ``copies`` is false: then pages with the same whole text count once, in the lines and in the host, so
that many copies of one page do not make boilerplate of its text. A host has fewer boilerplate lines than its mean number of lines per page divided by ``ratio``,
so one array per host holds them. Only 128-bit digests of lines are shuffled; a hot host is folded before its shuffle.
Extra columns pass through; the operator's own columns have names that begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.durable import durable

RATIO, MIN_PAGES = 0.1, 3
#: Hosts and digests (16 bytes each) up to which the boilerplate is broadcast instead of shuffling the pages by host.
BROADCAST_DIGESTS = 1_000_000


def digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """One row per host: ``__host``, ``__pages`` and ``__lines``, the digests of its boilerplate."""
    pages = df.select(F.col(host).alias("__host"), digest(F.col(text)).alias("__page"))
    pages = (pages if copies else pages.distinct()).groupBy("__host").agg(F.count("*").alias("__pages"))
    own = F.array_distinct(F.transform(split_lines(F.col(text)), lambda x: F.trim(x)))
    page = [] if copies else [digest(F.col(text)).alias("__page")]
    lines = df.select(F.col(host).alias("__host"), *page, F.explode(F.filter(own, lambda x: x != "")).alias("__line"))
    lines = lines.select("__host", *["__page" for _ in page], digest(F.col("__line")).alias("__key"))
    counts = (lines if copies else lines.distinct()).groupBy("__host", "__key").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    frequent = (
        counts.join(pages, counts["__host"].eqNullSafe(pages["__host"]))
        .where(F.col("__n") > F.lit(float(ratio)) * F.col("__pages"))
        .select(counts["__host"], "__pages", "__key")
    )
    return frequent.groupBy("__host").agg(F.first("__pages").alias("__pages"), F.sort_array(F.collect_list("__key")).alias("__lines"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """The rows with ``text`` without boilerplate, and ``__found`` and ``__dropped``, the numbers of lines."""
    found = durable(boilerplate(df, host, text, ratio, min_pages, copies).select("__host", "__lines"))
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size("__lines")), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= BROADCAST_DIGESTS else found
    rows = df.join(found, df[host].eqNullSafe(found["__host"]), "left")
    lines = split_lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__lines"), digest(F.trim(x))))
    rows = rows.withColumn("__kept", F.when(F.col("__lines").isNull(), lines).otherwise(kept))
    made = {text: F.array_join("__kept", "\n"), "__found": F.size(lines), "__dropped": F.size(lines) - F.size("__kept")}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in df.columns], made["__found"].alias("__found"), made["__dropped"].alias("__dropped"))


def query(docs: DataFrame) -> DataFrame:
    rows = drop_boilerplate(docs)
    return rows.select(
        "doc_id", "source", F.when(F.col("text").isNotNull(), F.col("__found")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.col("__dropped")).cast("long").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


KEPT_SQL = f"""
lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE text IS NOT NULL),
pages AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
seen AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL),
boiler AS (SELECT seen.source, line FROM seen JOIN pages ON seen.source IS NOT DISTINCT FROM pages.source
           WHERE seen.n >= {MIN_PAGES} AND seen.n > {RATIO}::DOUBLE * pages.n),
cleaned AS (
    SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
           coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text
    FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line GROUP BY l.doc_id)
"""
SQL = f"""WITH docs AS (SELECT * FROM documents), {KEPT_SQL}
SELECT doc_id, source, n_lines, n_dropped, sha256(cleaned.text) AS kept_sha256 FROM docs LEFT JOIN cleaned USING (doc_id)
"""
