"""Ranked lexical search by the three phases of TPUT over postings that are partitioned by term.

Documents are read in blocks; the list of a term is cut by block, so a common term is many
rows and never one task. A score is a sum over a query's terms of what each list holds for
the document, and in three phases only a part of the lists takes part:

1. The heads of all lists give each query partial sums; the least of its K best is a lower
   bound that K documents reach. The exact scores of the first of them, looked up, give a
   higher one.
2. The first bound over the query's number of terms is one threshold for all its lists: a
   document that is below it in every list cannot reach the bound. What is above is sent to the
   blocks and summed; with what the lists can still hold for it, every document has an upper bound.
3. The exact scores of the documents whose upper bound reaches the higher bound, and the K-th
   best partial sum, are looked up in the lists.

Queries are taken in lots of at most about LOT terms: this bounds what a task holds of them.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, table

#: Times K documents of the heads whose exact scores are looked up first.
FIRST = 3
#: Best documents of a query; query terms in a lot; documents and postings in a block; parts that a term's blocks are dealt to.
K, LOT, BLOCK_DOCS, BLOCK_POSTINGS, PARTS = 10, 20_000, 8192, 2_000_000, 16

_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _held(tf: np.ndarray, n: np.ndarray, w: int, n_docs: int, length: int) -> np.ndarray:
    """What a list of weight ``w`` holds for documents of ``n`` terms."""
    m = 10 + 90 * n * n_docs // length
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Lists of the ``wanted`` terms by block: (term: its place, block, at, tf, n). ``at`` are places in the block, ``n`` the documents' lengths.

    Each block also has a row of term -1 with its documents: ``n`` their lengths (0: no term) and ``ids`` their doc_ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = {t: k for k, t in enumerate(wanted)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys = TaskContext.get().partitionId() << 24, places.keys()
        lists, sizes, ids, held = defaultdict(lambda: ([], [])), [], [], 0

        def close():
            n = np.array(sizes, np.int64)
            found = sorted(lists)
            at = [np.array(lists[t][0], np.int32) for t in found]
            each = [np.zeros(0, np.int32), *at]
            tf = [np.zeros(0, np.int32), *(np.array(lists[t][1], np.int32) for t in found)]
            length = [n, *(n[x] for x in at)]
            none = pa.array([ids, *[None] * len(found)], pa.list_(of))
            out = [pa.array([-1, *found], pa.int32()), pa.array([block] * (1 + len(found)), pa.int64()), *(pa.array([*map(pa.array, x)], pa.list_(t)) for x, t in ((each, pa.int32()), (tf, pa.int32()), (length, pa.int64()))), none]
            return pa.RecordBatch.from_arrays(out, names=["term", "block", "at", "tf", "n", "ids"])

        for batch in batches:
            of = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms(text)
                count = Counter(words)
                common = [t for t in count if t in keys] if len(count) < len(keys) else count.keys() & keys
                for t in common:
                    at, tf = lists[places[t]]
                    at.append(len(ids)), tf.append(count[t])
                held += len(common)
                sizes.append(len(words)), ids.append(doc)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield close()
                    lists.clear(), sizes.clear(), ids.clear()
                    block, held = block + 1, 0
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(read, f"term int, block long, at array<int>, tf array<int>, n array<long>, ids array<{kind}>")


def _rows(batches: Iterator[pa.RecordBatch], *names: str):
    for batch in batches:
        columns = [batch.column(name) for name in names]
        for k in range(batch.num_rows):
            yield [c[k].values.to_numpy() if pa.types.is_list(c.type) else c[k].as_py() for c in columns]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def _heads(lists: DataFrame, w: list[int], n_docs: int, length: int, k: int) -> DataFrame:
    """(term, block, at, held): the k largest of each list."""
    schema = pa.schema([("term", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("held", pa.int64())])

    def top(batches):
        out = []
        for term, block, at, tf, n in _rows(batches, "term", "block", "at", "tf", "n"):
            held = _held(tf.astype(np.int64), n, w[term], n_docs, length)
            best = np.argpartition(-held, k - 1)[:k] if len(held) > k else np.arange(len(held))
            out += [(term, block, int(at[x]), int(held[x])) for x in best]
            if len(out) > 20_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("held"), "block", "at"))
    return lists.select("term", "block", "at", "tf", "n").mapInArrow(top, "term int, block long, at int, held long").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _candidates(lists: DataFrame, w: list[int], n_docs: int, length: int, k: int, items: list[np.ndarray], floor: list[int], bound: list[int], top: dict[int, int]) -> DataFrame:
    """(item, block, at, low, high): documents that the lists above the items' thresholds leave, with their partial sums and upper bounds.

    ``floor`` gives an item's threshold, ``bound`` is the score that K documents are known to reach.
    """
    share = [-(-f // len(t)) for f, t in zip(floor, items, strict=True)]
    least = np.full(len(w), np.iinfo(np.int64).max)
    for t, s in zip(items, share, strict=True):
        least[t] = np.minimum(least[t], max(s, 1))
    sent = pa.schema([("block", pa.int64()), ("term", pa.int32()), ("at", pa.list_(pa.int32())), ("held", pa.list_(pa.int64()))])
    schema = pa.schema([("item", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])

    def above(batches):
        out, size = [], 0
        for term, block, at, tf, n in _rows(batches, "term", "block", "at", "tf", "n"):
            held = _held(tf.astype(np.int64), n, w[term], n_docs, length)
            good = held >= least[term]
            if good.any():
                out.append((block, term, at[good], held[good]))
                size += int(good.sum())
            if size > 500_000:
                yield _batch(out, sent)
                out, size = [], 0
        yield _batch(out, sent)

    def one(block: int, held: dict[int, tuple[np.ndarray, np.ndarray]]):
        width = 1 + max(int(at[-1]) for at, _ in held.values())
        for item, (own, s) in enumerate(zip(items, share, strict=True)):
            low, seen = np.zeros(width, np.int64), np.zeros(width, np.int64)
            rest = 0
            for t in own.tolist():
                most = min(max(s, 1) - 1, top.get(t, 0))  # what a document outside the part above may have here
                rest += most
                if t in held:
                    at, h = held[t]
                    good = h >= s
                    low[at[good]] += h[good]
                    seen[at[good]] += most
            high = low + rest - seen
            reach = bound[item]
            if width > k:
                reach = max(reach, int(np.partition(low, width - k)[width - k]))
            found = np.flatnonzero((high >= reach) & (low > 0))
            yield from zip([item] * len(found), [block] * len(found), found.tolist(), low[found].tolist(), high[found].tolist(), strict=True)

    def bounds(batches):
        now, held, out = None, {}, []
        for block, term, at, h in _rows(batches, "block", "term", "at", "held"):
            if block != now:
                if held:
                    out += one(now, held)
                now, held = block, {}
                if len(out) > 50_000:
                    yield _batch(out, schema)
                    out = []
            held[term] = (at.copy(), h.copy())
        if held:
            out += one(now, held)
        yield _batch(out, schema)

    parts = lists.select("term", "block", "at", "tf", "n").mapInArrow(above, "block long, term int, at array<int>, held array<long>")
    n_parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n_parts, "block").sortWithinPartitions("block", "term").mapInArrow(bounds, "item int, block long, at int, low long, high long")


def _looked_up(lists: DataFrame, asked: DataFrame, w: list[int], n_docs: int, length: int) -> DataFrame:
    """(item, block, at, held) for asked (item, block, at, term): one row for each that the lists have."""
    schema = pa.schema([("item", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("held", pa.int64())])
    wanted = asked.groupBy("term", "block").agg(F.collect_list("item").alias("items"), F.collect_list("at").alias("places"))

    def look(batches):
        out = []
        for term, block, at, tf, n, who, where in _rows(batches, "term", "block", "at", "tf", "n", "items", "places"):
            k = np.minimum(np.searchsorted(at, where), len(at) - 1)
            good = at[k] == where
            held = _held(tf[k[good]].astype(np.int64), n[k[good]], w[term], n_docs, length)
            out += zip(who[good].tolist(), [block] * len(held), where[good].tolist(), held.tolist(), strict=True)
            if len(out) > 50_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    joined = lists.join(wanted, ["term", "block"]).select("term", "block", "at", "tf", "n", "items", "places")
    return joined.mapInArrow(look, "item int, block long, at int, held long")


def _lot(docs: DataFrame, queries: list[tuple], k: int, item_id: str) -> DataFrame:
    spark = docs.sparkSession
    wanted = sorted({t for _, own in queries for t in own})
    places = {t: i for i, t in enumerate(wanted)}
    items = [np.array(sorted(places[t] for t in own), np.int64) for _, own in queries]
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS))
    lists = staged(postings(docs, wanted).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "term", part), "postings", "zstd")
    blocks, lists = lists.where("term < 0"), lists.where("term >= 0")
    n_docs, length = blocks.select(F.sum(F.size(F.filter("n", lambda x: x > 0))), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum(F.size("at")).alias("df")).collect()}
    n_docs, length = n_docs or 0, length or 0
    w = [weight(n_docs, df.get(i, 0)) for i in range(len(wanted))]

    heads = _heads(lists, w, n_docs, length, k).collect()  # k rows for each term of the lot
    of, top = defaultdict(list), {}
    for r in heads:
        of[r.term].append((r.block, r.at, r.held))
        top[r.term] = max(top.get(r.term, 0), r.held)
    floor, first = [], []
    for i, own in enumerate(items):
        sums = Counter()
        for t in own.tolist():
            for block, at, held in of[t]:
                sums[block, at] += held
        best = sums.most_common(FIRST * k)
        floor.append(best[k - 1][1] if len(best) >= k else 0)
        first += [(i, block, at) for (block, at), _ in best]

    rank = lambda by: F.row_number().over(Window.partitionBy("item").orderBy(*by))
    asks = spark.createDataFrame([(i, own.tolist()) for i, own in enumerate(items)], "item int, terms array<int>")
    scored = lambda rows: _looked_up(lists, rows.join(asks, "item").select("item", "block", "at", F.explode("terms").alias("term")), w, n_docs, length).groupBy("item", "block", "at").agg(F.sum("held").alias("score"))
    exact = scored(spark.createDataFrame(first, "item int, block long, at int"))
    reached = {r.item: r.score for r in exact.withColumn("r", rank([F.desc("score")])).where(F.col("r") == k).collect()}
    bound = [max(f, reached.get(i, 0)) for i, f in enumerate(floor)]
    found = staged(_candidates(lists, w, n_docs, length, k, items, floor, bound, top), "candidates", "zstd")
    least = found.withColumn("r", rank([F.desc("low")])).where(F.col("r") == k).select("item", F.col("low").alias("bound"))
    left = found.join(least, "item", "left").where(F.col("high") >= F.coalesce("bound", F.lit(0)))
    scores = scored(left.select("item", "block", "at")).where("score > 0")
    # Ties at the end need doc_ids, so all that reach the K-th score get theirs.
    enough = scores.withColumn("r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= k)
    names = blocks.select("block", F.posexplode("ids").alias("at", "doc_id"))
    named = enough.join(names, ["block", "at"]).withColumn("rank", rank([F.desc("score"), F.asc_nulls_last("doc_id"), "block", "at"])).where(F.col("rank") <= k)
    keys = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(queries)], f"item int, item_id {item_id}")
    out = staged(named.join(keys, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(found)
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = K, lot: int = LOT) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each query (item_id, text).

    Documents without any of a query's terms are not listed, so a query without terms, or
    whose terms no document has, has no row. Equal scores stand by ascending doc_id, null
    last. Repeated doc_ids are documents of their own, and so are repeated item_ids. Other columns
    are dropped. Scores are exact; nothing is left out by lots or blocks.
    """
    spark = docs.sparkSession
    item_id = queries.schema["item_id"].dataType.simpleString()
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = staged(queries.select("item_id", F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM.pattern), F.lit(0))).alias("terms")).where(F.size("terms") > 0), "queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    lots = -(-total // lot)
    dealt = F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(lots, 1)))
    out = spark.createDataFrame([], f"item_id {item_id}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for j in range(lots):
        rows = [(r.item_id, r.terms) for r in asked.where(dealt == j).collect()]
        if rows:
            out = out.unionByName(_lot(docs, rows, k, item_id))
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
x AS (SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
