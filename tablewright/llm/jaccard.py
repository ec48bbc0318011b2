"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set are its distinct 5-word shingles (A-Z in lower case; with fewer words the whole sequence, without words
nothing). Two documents link when ``100 * intersection >= percent * union``.

Shingles have a global order, that of their fingerprints. Of a set of n, the prefix of level l are the first
``n - ceil(n * percent / 100) + l``: two linked sets share at least l shingles of their prefixes, for the smaller of their
levels. Each document lengthens its prefix by estimated cost: a higher level lists more shingles, but only those pairs that share
correspondingly more of them are verified, and up to l - 1 frequent shingles need not be listed at all. So:

1. Sets that are equal become one class; only its smallest id goes on.
2. The frequency of every shingle in the longest prefixes is counted over the corpus (a round of ``twins``).
3. Each class takes the level of least cost. Its listed shingles stand in at most ``FREQUENT`` sets and are joined;
   pairs with enough matches are candidates. A class whose prefix is frequent at every level is listed with all of them
   and a star around each frequent shingle holds such classes together.
4. Candidates and stars form families; the sets of a family meet in tasks of bounded size, large families block by
   block, and all links are verified on the whole sets.

Fingerprints have 64 bits; equal sets are told by 128. Null and empty texts have no shingles and are linked with
nothing. Rows with the same id are one document; null ids come last and count as one document. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import rolling, twins
from tablewright.llm.components import components
from tablewright.plans.durable import durable

WORDS, PERCENT = 5, 80
#: Shingles in more sets than this are frequent: they are not joined pair by pair.
FREQUENT = 32
#: Cost of verifying a pair, in units of one joined row.
VERIFY_COST = 4.0
#: Shingles of the sets that meet in one task.
TASK_SHINGLES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Sets:
    """Sets of some documents of a chunk: ``tokens`` ascending, ``borders`` by document."""

    def __init__(self, row: dict, chosen: np.ndarray | None = None):
        ids, texts = twins.unpack(row["body"])
        self.chosen = np.arange(len(ids)) if chosen is None else chosen
        self.ids = ids[self.chosen]
        buffer, borders = rolling.byte_array([texts[k] for k in self.chosen])
        buffer = LOWER[buffer]
        starts, ends, first = rolling.words(buffer, borders)
        words = rolling.spans(rolling.BYTE_VALUES[buffer], starts, ends)
        size = np.diff(first)
        of, at = np.repeat(np.arange(len(size)), size), np.arange(len(words))
        begins = at[(at + WORDS <= first[of + 1]) | ((at == first[of]) & (size[of] < WORDS))] if len(at) else at
        stops = np.minimum(begins + WORDS, first[of[begins] + 1]) if len(at) else at
        tokens = rolling.spans(words, begins, stops)
        doc = of[begins] if len(at) else at
        order = np.lexsort((tokens, doc))
        tokens, doc = tokens[order], doc[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
        self.tokens, doc = tokens[new], doc[new]
        self.borders = np.searchsorted(doc, np.arange(len(size) + 1))
        self.n = np.diff(self.borders)

    def digest(self, seed: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(rolling.mix(self.tokens, seed), dtype=np.uint64)])
        return (sums[self.borders[1:]] - sums[self.borders[:-1]]).view(np.int64)

    def prefix(self, percent: int) -> np.ndarray:
        """Places of the tokens of the longest prefixes."""
        lengths = np.minimum(self.n, base(self.n, percent) + longest(self.n, percent))
        ends = np.cumsum(lengths)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.borders[:-1] - ends + lengths, lengths)


def base(n, percent: int):
    return n - (n * percent + 99) // 100


def highest(n):
    """The highest level a set may choose."""
    return 8 + n // 16


def longest(n, percent: int):
    """The level of the longest prefix: the highest that any set it may be linked with can choose."""
    return highest((n * 100 + percent - 1) // percent + 1)


def choose(frequency: np.ndarray, n: int, percent: int, frequent: int) -> tuple[int, int, np.ndarray] | None:
    """Level, matches needed and places of the shingles to list, from the frequencies in the longest prefix.

    Level 0: frequent at every level, list all. None: too few shingles are shared at all to be linked with anything.
    """
    start, most = base(n, percent), longest(n, percent)
    shared, hot = frequency > 1, frequency > frequent
    levels = np.arange(1, most + 1)
    ends = np.minimum(start + levels, n)
    levels = np.minimum(levels, ends - start)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
    within = np.arange(1, most + 1) <= highest(n)  # there, every set it may be linked with has told its shingles
    if (sums(shared) < levels)[within].any():
        return None
    listed = shared & ~hot
    rows, need = sums(np.where(listed, frequency, 0)), levels - sums(hot)
    allowed = (need >= 1) & within
    if not allowed.any():
        return 0, 0, np.flatnonzero(shared)
    cost = np.where(allowed, rows + VERIFY_COST * rows / np.maximum(need, 1), np.inf)
    best = int(np.argmin(cost))
    return int(levels[best]), int(need[best]), np.flatnonzero(listed[: ends[best]])


def _frequencies(prints: np.ndarray, more: dict[str, np.ndarray]) -> np.ndarray:
    order, first, sizes = twins.groups(prints)
    return np.minimum(twins.together(np.add, more["sets"].astype(np.int64), order, first, sizes), 255)


def classes(chunks: DataFrame) -> DataFrame:
    """``doc_id``, ``chunk``, ``place`` in it, ``n``, and of each class of equal sets ``class`` (smallest id) and ``leads`` (one row each)."""

    def work(batches):
        for row in twins.rows_of(batches):
            sets = Sets(row)
            columns = [sets.ids, np.full(len(sets.ids), row["chunk"]), sets.chosen, sets.n, sets.digest(11), sets.digest(13)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["doc_id", "chunk", "place", "n", "one", "two"])

    rows = durable(chunks.mapInArrow(work, "doc_id bigint, chunk bigint, place bigint, n bigint, one bigint, two bigint"))
    key = ["n", "one", "two"]
    leads = rows.where("n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "chunk", "place")).alias("lead"), F.count("*").alias("weight"))
    found = rows.join(leads, key, "left")
    own = F.struct("doc_id", "chunk", "place")
    return durable(found.select("doc_id", "chunk", "place", "n", F.coalesce("lead.doc_id", "doc_id").alias("class"), (F.col("lead") == own).alias("leads"), "weight"))


def _places(rows: DataFrame, name: str) -> DataFrame:
    """Per chunk the places of its rows; bounded by the chunk."""
    return rows.groupBy("chunk").agg(F.sort_array(F.collect_list("place")).alias(name))


def listings(chunks: DataFrame, members: DataFrame, percent: int, frequent: int) -> DataFrame:
    """``class``, ``level``, ``need`` and ``tokens`` of the classes that may be linked with anything."""
    led = chunks.join(_places(members.where("leads"), "led"), "chunk")

    def count(row):
        sets = Sets(row, np.array(row["led"]))
        prints, _, order, first = twins.told(sets.tokens[sets.prefix(percent)])
        return {"prints": prints, "sets": np.diff(np.append(first, len(order))).clip(max=255)}

    def work(batches):
        for row in twins.rows_of(batches):
            sets = Sets(row, np.array(row["led"]))
            tokens = sets.tokens[sets.prefix(percent)]
            _, place, _, _ = twins.told(tokens)
            frequency = twins.read_answers(row["frequencies"])[place].astype(np.int64)
            ends = np.cumsum(np.minimum(sets.n, base(sets.n, percent) + longest(sets.n, percent)))
            out, low = [], 0
            for doc, n, high in zip(sets.ids.tolist(), sets.n.tolist(), ends.tolist()):
                found = choose(frequency[low:high], n, percent, frequent)
                if found is not None:
                    level, need, at = found
                    own = tokens[low:high][at]
                    out.append((doc, level, need, own.view(np.int64).tolist(), (frequency[low:high][at] > frequent).tolist()))
                low = high
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["class", "level", "need", "tokens", "hot"])

    counted = twins.with_answers(led, twins.round_(led, count, _frequencies, 6, {"sets": "u1"}), "frequencies")
    return durable(counted.mapInArrow(work, "class bigint, level bigint, need bigint, tokens array<bigint>, hot array<boolean>"))


def candidates(listed: DataFrame) -> DataFrame:
    """Pairs of classes that share enough listed shingles, and the stars around frequent ones."""
    rows = listed.select("class", "level", "need", F.explode(F.arrays_zip("tokens", "hot")).alias("x"))
    rows = rows.select("class", "level", "need", F.col("x.tokens").alias("token"), F.col("x.hot").alias("hot"))
    plain = rows.where("NOT hot").drop("hot")
    other = plain.select("token", *[F.col(c).alias(f"other_{c}") for c in ("class", "level", "need")])
    # level 0 stands for the longest prefix: the other side's level is the smaller one
    need = (
        F.when(F.col("level") == 0, F.col("other_need")).when(F.col("other_level") == 0, F.col("need"))
        .when(F.col("level") < F.col("other_level"), F.col("need")).when(F.col("level") > F.col("other_level"), F.col("other_need"))
        .otherwise(F.greatest("need", "other_need"))
    )
    pairs = plain.join(other, "token").where("class < other_class AND (level > 0 OR other_level > 0)")
    pairs = pairs.groupBy("class", "other_class").agg(F.count("*").alias("matches"), F.first(need).alias("needed")).where("matches >= needed")
    alike = rows.where("level = 0")  # frequent at every level: both of a pair are, and share some token
    centres = alike.groupBy("token").agg(F.min("class").alias("centre"), F.count("*").alias("sets")).where("sets > 1")
    stars = alike.join(centres, "token").where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b"))
    return pairs.select(F.col("class").alias("a"), F.col("other_class").alias("b")).unionByName(stars).distinct()


def links(chunks: DataFrame, members: DataFrame, pairs: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """``a``, ``b`` (classes; enough links to hold the linked ones together, a = b for the rest) and ``links`` of a."""
    family = durable(components(pairs))
    led = members.where("leads").select("class", "chunk", "place", "n", "weight")
    led = led.join(family.withColumnRenamed("node", "class"), "class")
    sizes = led.groupBy("component").agg(F.sum("n").alias("shingles"))
    total = sizes.agg(F.sum("shingles")).first()[0] or 0
    tasks = max(1, -(-2 * total // task_shingles))
    sizes = sizes.select("component", F.ceil(F.col("shingles") / (task_shingles // 2)).cast("int").alias("blocks"))
    led = led.join(sizes, "component")
    led = led.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
    # a small family goes whole to a task; of a large one, each two blocks meet in a task
    small = F.array(F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(tasks))))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.concat_ws("-", "component", F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
    led = durable(led.select("class", "chunk", "place", "weight", "block", F.when(F.col("blocks") == 1, small).otherwise(met).alias("tasks")))
    wanted = led.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "class", "weight", "block", "tasks"))).alias("wanted"))

    def fetch(batches):
        for row in twins.rows_of(batches):
            wanted = row["wanted"]
            sets = Sets(row, np.array([w["place"] for w in wanted]))
            raw = [sets.tokens[a:b].tobytes() for a, b in zip(sets.borders[:-1], sets.borders[1:])]
            columns = [pa.array([w[c] for w in wanted], k) for c, k in (("class", pa.int64()), ("weight", pa.int64()), ("block", pa.int32()), ("tasks", pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], names=["class", "weight", "block", "tasks", "tokens"])

    sets = chunks.join(wanted, "chunk").mapInArrow(fetch, "class bigint, weight bigint, block int, tasks array<string>, tokens binary")
    sets = sets.select("class", "weight", "block", "tokens", F.explode("tasks").alias("task"))

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        ids, weight = table.column("class").to_numpy(), table.column("weight").to_numpy()
        task, block = table.column("task")[0].as_py(), table.column("block").to_numpy()
        parts = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
        n = np.array([len(x) for x in parts])
        _, token = np.unique(np.concatenate(parts), return_inverse=True)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(token, kind="stable")
        posted, ends = doc[order], np.cumsum(np.bincount(token))
        begins, first = np.concatenate([[0], ends[:-1]]), np.cumsum(n) - n
        # blocks of one family meet in several tasks; a pair within a block is judged where the block meets itself
        apart = not task.startswith("s-") and task.rsplit("-", 2)[1] != task.rsplit("-", 2)[2]
        root, found = np.arange(len(n)), np.zeros(len(n), dtype=np.int64)

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in range(len(n)):
            own = token[first[k] : first[k] + n[k]]
            sizes = ends[own] - begins[own]
            cuts = np.cumsum(sizes)
            common = np.bincount(posted[np.arange(cuts[-1]) + np.repeat(begins[own] - cuts + sizes, sizes)], minlength=len(n))
            linked = np.flatnonzero(100 * common >= percent * (n + n[k] - common))
            linked = linked[(linked > k) & ((block[linked] != block[k]) | (not apart))]
            found[k] += weight[linked].sum()
            found[linked] += weight[k]
            for x in {top(x) for x in linked.tolist()}:
                a, b = sorted((top(k), x))
                root[b] = a
        roots = ids[[top(k) for k in range(len(n))]]
        return pa.table({"a": pa.array(ids), "b": pa.array(roots), "links": pa.array(found)})

    return durable(sets.groupBy("task").applyInArrow(verify, "a bigint, b bigint, links bigint"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, frequent: int = FREQUENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``n_links``."""
    chunks = twins.pack(docs, doc_id, text)
    members = classes(chunks)
    found = links(chunks, members, candidates(listings(chunks, members, percent, frequent)), percent, task_shingles)
    component = components(found).withColumnRenamed("node", "class")
    linked = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    rows = members.join(component, "class", "left").join(linked, "class", "left")
    return rows.select(
        twins.given_id(), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "class"), F.lit(twins.NO_ID)).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"),
    )


#: Ids up to which the documents to drop are broadcast.
BROADCAST_IDS = 1_000_000


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; rows of the same id and text count once, null ids stay."""
    found = durable(join(docs, doc_id, text).select(F.col("doc_id").alias("__id"), "component_id"))
    gone = found.where("__id <> component_id").select("__id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, F.col(doc_id).cast("long") == F.col("__id"), "left_anti")
    again = found.where("__id IS NOT NULL").groupBy("__id").count().where("count > 1").select("__id")
    if again.take(1):
        kept = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text]).unionByName(kept.where(F.col(doc_id).isNull()))
    return kept


def query(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p : p + 4], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""
