"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for candidate credentials. The hashes of their values are aggregated over the whole corpus by
distinct owners and repositories: a value that many owners hold is a widely copied example, one that stays with few is
owner-specific and live-looking. Base kinds are always reported; further kinds only where they look live.

Offsets are code points, end exclusive. The owner is the source of a document, its repository is source and language.
Null texts have no spans; null owners count as one owner. Repeated rows give repeated results but no further owners.
Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.arrow import shares
from tablewright.plans.durable import durable

#: From this number of distinct owners on, a value counts as a copied example.
COPIED_OWNERS = 3

# The base kinds in their order.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Further kinds: a literal that must be there, and the pattern; group 1 is the value.
FURTHER = {
    "github": ("gh", re.compile(r"\b(gh[pousr]_[A-Za-z0-9]{36,255})")),
    "slack": ("xox", re.compile(r"\b(xox[abprs]-[A-Za-z0-9-]{10,250})")),
    "google": ("AIza", re.compile(r"\b(AIza[A-Za-z0-9_-]{35})")),
    "jwt": ("eyJ", re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    "bearer": ("earer ", re.compile(r"\b[Bb]earer ([A-Za-z0-9._~+/-]{20,})")),
    "url": ("://", re.compile(r"://[^\s/:@]{1,100}:([^\s/:@]{8,200})@")),
    "key": ("PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----([^-]{40,})-----END")),
}
KINDS = (*BASE, *FURTHER)
FOUND = T.ArrayType(T.StructType().add("kind", "string").add("low", "integer").add("high", "integer").add("value", "binary"))


def candidates(text: str | None) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, hash of the value) of one text, kind by kind."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    for kind, (literal, pattern) in FURTHER.items():
        if literal in text:
            found += [(kind, *m.span(), m[1]) for m in pattern.finditer(text)]
    return [(kind, low, high, hashlib.blake2b(value.encode(), digest_size=16).digest()) for kind, low, high, value in found]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``__id``, ``__owner``, ``__repository`` and ``__found``, the candidates of each document."""
    narrow = docs.select(
        F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(owner).cast("string").alias("__owner"),
        F.to_json(F.struct(*repository)).alias("__repository"),
    )
    struct = pa.struct([("kind", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("value", pa.binary())])

    def work(batches):
        for batch in batches:
            for part in shares(batch, 1, 8 << 20):
                rows = [[dict(zip(("kind", "low", "high", "value"), x)) for x in candidates(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(rows, type=pa.list_(struct))],
                    names=["__id", "__owner", "__repository", "__found"],
                )

    return narrow.mapInArrow(work, T.StructType([*narrow.select("__id", "__owner", "__repository").schema, T.StructField("__found", FOUND)]))


def ownership(found: DataFrame) -> DataFrame:
    """Per value: documents, distinct owners and repositories, and whether it is a copied example."""
    values = found.select(F.explode("__found.value").alias("value"), F.coalesce("__owner", F.lit("")).alias("owner"), F.col("__repository").alias("repository"))
    by_repository = values.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    totals = by_owner.groupBy("value").agg(
        F.sum("n").alias("uses"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories")
    )
    return totals.withColumn("copied", F.col("owners") >= COPIED_OWNERS)


def report(found: DataFrame) -> DataFrame:
    """One row per span: where it is, how its value is spread, and ``reported``."""
    spans = found.select("__row", "__id", F.explode("__found").alias("x")).select("__row", "__id", "x.*")
    return spans.join(ownership(found), "value").withColumn("reported", F.col("kind").isin(*BASE) | ~F.col("copied"))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind in order."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["low"].alias("low"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["high"].alias("high"), x["kind"].alias("kind")
    )))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["low"], x["high"])), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("__found", lambda x: x["kind"] == kind)


def query(docs: DataFrame) -> DataFrame:
    """Per document the counts and spans; ``n_live`` and ``n_copied`` count values by ownership."""
    found = durable(scan(docs).withColumn("__row", F.monotonically_increasing_id()))
    spread = report(found).groupBy("__row").agg(
        F.collect_list(F.when(F.col("reported"), F.struct("kind", "low", "high"))).alias("shown"),
        F.sum(F.col("copied").cast("long")).alias("n_copied"), F.sum((~F.col("copied")).cast("long")).alias("n_live"),
    )
    base = F.filter("__found", lambda x: x["kind"].isin(*BASE))
    none = F.array().cast("array<struct<kind:string,low:int,high:int>>")
    return found.join(spread, "__row", "left").select(
        F.col("__id").alias("doc_id"),
        *[F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.coalesce("shown", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
