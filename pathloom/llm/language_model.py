"""Katz backoff bigram model of a corpus, and the score of every text under it.

P(w | v) = d_r * r / D(v) for a pair seen r > 0 times in training (d_r: Good-Turing
discount, 1 beyond K), else alpha(v) * P(w); P(w) = (c + 1) / (N + V + 1), which leaves one
share for all unknown words. alpha(v) gives each history exactly the probability that its
discounts free. A history without discounted pairs has D(v) = its count + 1, else its count;
an unknown history has alpha 1.

Texts are coded once, in stretches of bounded size: one row with the stretch's own words and
the places of its tokens among them. Counts are rows of tables, by 64-bit hashes:

* words (w, stretch, j, n): summed over all stretches by w, which gives N, V and each stretch
  the counts of its words;
* pairs (k, stretch, i, n): summed by k. Only pairs that more stretches know are sent back,
  as the others' counts are those of the one stretch that has them. One stretch owns each
  pair, and adds it to the sums of its history;
* histories (v, whole, alpha), from these sums, sent back to the stretches that have v.

Each row that moves is one distinct word or pair of one stretch, so all shuffles grow in
proportion to the input, and a pair or word that all texts share is one row in each stretch.
"""
from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import npbytes as nb
from .common import discard, remove, staged, table, text_or_empty

#: Counts up to K are discounted; bytes of text in a stretch; passes over the pairs, by their hash, and turns of the stretches: the files of one are gone before the next.
K, STRETCH_BYTES, PASSES, TURNS = 5, 8 << 20, 4, 4
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2"
START, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_START = int(START.view(np.int64))
_LOW = [f"r{k}" for k in range(1, K + 1)]


@contextlib.contextmanager
def _few_rows(spark: SparkSession):
    """While it holds, Python gets the large rows of coded stretches one by one."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _one(values) -> pa.ListArray:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch: its texts, its words by frequency, and the word of each token; every text ends with END."""
    stretch = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = nb.buffers(batch.column("text"))
        for a, b in nb.groups(offsets, STRETCH_BYTES):
            part, off = nb.lower_az(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            starts, ends, first = nb.words(part, off)
            sizes = np.diff(first) + 1
            stops = np.cumsum(sizes)
            word = np.full(int(stops[-1]), END, np.uint64)
            inner = np.ones(len(word), bool)
            inner[stops - 1] = False
            word[inner] = nb.word_hashes(part, starts, ends)
            values, place = np.unique(word, return_inverse=True)
            order = np.argsort(-np.bincount(place), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            rows = batch.slice(a, b - a)
            stretch += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([stretch], pa.int64()), _one(rows.column("doc_id")), _one(rows.column("held_out")), _one(sizes.astype(np.int32)), _one(nb.as_long(values[order])), _one(rank[place])],
                names=["stretch", "doc_id", "held_out", "sizes", "words", "tokens"])


class Stretch:
    """One coded row as arrays."""

    def __init__(self, row):
        get = lambda name: row.column(name)[0].values
        self.id = row.column("stretch")[0].as_py()
        self.doc_id, self.held = get("doc_id"), np.asarray(get("held_out").to_numpy(zero_copy_only=False), bool)
        self.sizes, self.tokens = get("sizes").to_numpy().astype(np.int64), get("tokens").to_numpy().astype(np.int64)
        self.words = get("words").to_numpy().view(np.uint64)
        self.train = np.repeat(~self.held, self.sizes)
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        #: The number of the START history is that of one word more.
        self.history = history

    def pairs(self) -> np.ndarray:
        return self.history * len(self.words) + self.tokens

    def named(self, numbers: np.ndarray) -> np.ndarray:
        return np.append(self.words, START)[numbers]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Stretch(batch.slice(k, 1))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in _stretches(batches):
        n = np.bincount(s.tokens[s.train], minlength=len(s.words))
        yield pa.RecordBatch.from_arrays([pa.array(nb.as_long(s.words)), pa.array(np.full(len(n), s.id)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int32))], names=["w", "stretch", "j", "n"])


def _pair_rows(turn: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches):
            both = np.sort(s.pairs() * 2 + s.train)
            key = both >> 1
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n, key = np.add.reduceat(both & 1, heads), key[heads]
            v, w = key // len(s.words), key % len(s.words)
            k = nb.mix(s.named(w) * np.uint64(0x9E3779B97F4A7C15) + nb.mix(s.named(v)))
            mine = np.flatnonzero(k % np.uint64(PASSES) == turn)
            for at in range(0, len(mine), 100_000):
                i = mine[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(nb.as_long(k[i])), pa.array(np.full(len(i), s.id)), pa.array(i.astype(np.int32)), pa.array(n[i].astype(np.int32))], names=["k", "stretch", "i", "n"])

    return rows


def _counted_schema(kind: str) -> str:
    return f"kind string, stretch long, v long, {', '.join(f'{r} int' for r in _LOW)}, big long, below long, doc_id array<{kind}>, held_out array<boolean>, sizes array<int>, known array<int>, unseen array<int>, low array<int>, base array<double>, plain array<double>, codes array<int>"


def _count(left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """What a stretch knows once it has the counts of its words and pairs.

    A row of sums for each history of the pairs it owns, a row of its texts (sums over their tokens and, for each token,
    2 * history + whether its pair is known), and one with how many owned pairs are seen 1 to K + 1 times.
    """
    if not left.num_rows:
        return schema.empty_table()
    s = Stretch(left.combine_chunks())
    width = len(s.words)
    is_pair, at = right.column("pair").to_numpy(), right.column("i").to_numpy()
    x, own_reply = right.column("x").to_numpy(), right.column("own").to_numpy()
    c = np.zeros(width, np.int64)
    c[at[~is_pair]] = x[~is_pair]
    key, place = np.unique(s.pairs(), return_inverse=True)
    r = np.bincount(place, s.train, len(key)).astype(np.int64)
    own = r > 0
    r[at[is_pair]], own[at[is_pair]] = x[is_pair], own_reply[is_pair]

    v, w, mine = key[own] // width, key[own] % width, r[own]
    sums = {f"r{k}": np.bincount(v, mine == k, width + 1).astype(np.int32) for k in range(1, K + 1)}
    sums["big"] = np.bincount(v, np.where(mine > K, mine, 0), width + 1).astype(np.int64)
    sums["below"] = np.bincount(v, c[w] + 1, width + 1).astype(np.int64)
    some = np.unique(v)
    n = len(some)

    owner = np.repeat(np.arange(len(s.sizes)), s.sizes)
    seen, counts = r[place], c[s.tokens]
    add = lambda values: np.bincount(owner, values, len(s.sizes))
    log_c = np.log10(counts + 1)
    low = np.stack([add(seen == k) for k in range(1, K + 1)], axis=1).astype(np.int32)
    texts = {
        "doc_id": s.doc_id, "held_out": pa.array(s.held), "sizes": s.sizes.astype(np.int32), "known": add(counts > 0).astype(np.int32), "unseen": add(seen == 0).astype(np.int32), "low": low.ravel(),
        "base": add(log_c), "plain": add(np.where(seen > K, np.log10(np.maximum(seen, 1)), np.where(seen > 0, 0.0, log_c))), "codes": (s.history * 2 + (seen > 0)).astype(np.int32)}
    stats = np.bincount(np.minimum(mine, K + 2), minlength=K + 3)[1 : K + 2].astype(np.int32)
    rows = [
        {"kind": pa.array(["history"] * n), "v": pa.array(nb.as_long(s.named(some))), **{name: pa.array(a[some]) for name, a in sums.items()}},
        {"kind": pa.array(["texts"]), "stretch": pa.array([s.id]), **{name: _one(a) for name, a in texts.items()}},
        {"kind": pa.array(["stats"]), "low": _one(stats)},
    ]
    return pa.concat_tables([pa.table([r[f.name].cast(f.type) if f.name in r else pa.nulls(len(r["kind"]), f.type) for f in schema], schema=schema) for r in rows])


def discounts(counts: list[int]) -> list[float]:
    """Good-Turing d_1..d_K from the numbers of pairs seen 1 to K + 1 times, all by one rule.

    The counts are taken as they are if they give 0 < d < 1 and a pair seen more often never
    keeps less. Else they are smoothed by a line through their logarithms; where that
    falls no faster than 1 / r, or there is none, d is (r - 0.5) / r.
    """

    def katz(n: list[float]) -> list[float]:
        cut = (K + 1) * n[K] / n[0]
        return [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) for r in range(1, K + 1)] if cut < 1 else []

    def sound(d: list[float]) -> bool:
        kept = [r * x for r, x in enumerate(d, 1)]
        return bool(d) and all(0 < x < 1 for x in d) and all(x < y for x, y in zip(kept, kept[1:]))

    if all(counts) and sound(d := katz(counts)):
        return d
    seen = [(math.log(r), math.log(n)) for r, n in enumerate(counts, 1) if n]
    if len(seen) > 1:
        x, y = np.array(seen).T
        slope = float(np.polyfit(x, y, 1)[0])
        if slope < -1 and sound(d := katz([r**slope for r in range(1, K + 2)])):
            return d
    return [(r - 0.5) / r for r in range(1, K + 1)]


def backoff(sums: DataFrame, d: list[float], slots: int) -> DataFrame:
    """(v, whole, alpha), as log10, of histories from rows of sums (v, r1.., big, below)."""
    total = sums.groupBy("v").agg(*[F.sum(c).alias(c) for c in (*_LOW, "big", "below")])
    low = sum((F.col(r) for r in _LOW), F.lit(0))
    n = sum((F.lit(k) * F.col(r) for k, r in enumerate(_LOW, 1)), F.col("big"))
    mass = sum((F.lit(k * x) * F.col(r) for k, (x, r) in enumerate(zip(d, _LOW, strict=True), 1)), F.col("big").cast("double"))
    whole = n + (low == 0).cast("int")
    alpha = F.log10((1 - mass / whole) / (1 - F.col("below") / F.lit(float(slots))))
    return total.select("v", F.log10(whole).alias("whole"), alpha.alias("alpha"))


def _finish(left: pa.Table, right: pa.Table, schema: pa.Schema, start: tuple[float, float], d: list[float], slots: int, train: int) -> pa.Table:
    """The scores of a stretch's texts, once it has what its histories add: -whole for a known pair, else alpha."""
    if not left.num_rows:
        return schema.empty_table()
    left = left.combine_chunks()
    get = lambda name: left.column(name)[0].values
    sizes, codes = get("sizes").to_numpy().astype(np.int64), get("codes").to_numpy()
    value = np.zeros(int(codes.max()) + 2 + 2)
    last = len(value) // 2
    j = right.column("j").to_numpy()
    there = j < last
    value[2 * j[there] + 1], value[2 * j[there]] = -right.column("whole").to_numpy()[there], right.column("alpha").to_numpy()[there]
    number = codes[np.cumsum(sizes) - sizes] // 2  # of START: each text's first history
    if len(number):
        value[2 * number[0] + 1], value[2 * number[0]] = -start[0], start[1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(owner, value[codes], len(sizes))
    low = get("low").to_numpy().reshape(-1, K)
    score = low @ np.log10(np.arange(1, K + 1) * np.array(d)) + get("plain").to_numpy() - get("unseen").to_numpy() * np.log10(slots) + shared
    base = get("base").to_numpy() - sizes * np.log10(slots)
    columns = {"doc_id": get("doc_id"), "held_out": get("held_out"), "n_tokens": sizes, "n_known": get("known").to_numpy().astype(np.int64), "train_tokens": np.full(len(sizes), train), "base_score": base, "score": score}
    return pa.table([(v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for f, v in zip(schema, columns.values(), strict=True)], schema=schema)


def score(docs: DataFrame, held_out: str = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text, ...).

    The model learns from the rows for which the SQL condition ``held_out`` is false or null.
    Null and empty texts have one token, the end. Rows are never told apart by their id, so null and
    repeated ids and repeated rows count and are scored each by itself. With nothing to learn
    from, N and V are 0 and every token has probability 1. An empty table gives an empty one.
    Further columns are ignored. A text longer than STRETCH_BYTES is a stretch of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    turn_of = F.pmod(F.xxhash64("stretch"), F.lit(TURNS)).cast("int")
    coded = rows.mapInArrow(_code, f"stretch long, doc_id array<{kind}>, held_out array<boolean>, sizes array<int>, words array<long>, tokens array<int>")
    codes = staged(coded.withColumn("turn", turn_of), "codes", "zstd", "turn")

    with _few_rows(spark):
        found = codes.mapInArrow(_word_rows, "w long, stretch long, j int, n int")
        every = W.partitionBy("w")
        found = found.withColumn("c", F.sum("n").over(every)).withColumn("first", F.col("stretch") == F.min("stretch").over(every))
        words = staged(found.drop("n"), "words", "zstd")
        replies = []
        for k in range(PASSES):
            pairs, same = codes.mapInArrow(_pair_rows(k), "k long, stretch long, i int, n int"), W.partitionBy("k")
            known = pairs.withColumns({"r": F.sum("n").over(same), "m": F.count("*").over(same), "owner": F.min(F.when(F.col("n") > 0, F.col("stretch"))).over(same)})
            known = known.where("m > 1 AND r > 0").select("stretch", "i", "r", (F.col("owner") == F.col("stretch")).alias("own"), turn_of.alias("turn"))
            replies.append(staged(known, f"pairs{k}", "zstd", "turn"))

    totals = words.where("first").agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    train, slots = int(totals[0] or 0), int(totals[0] or 0) + int(totals[1] or 0) + 1
    ready = spark.createDataFrame([], _counted_schema(kind)).schema
    inner = to_arrow_schema(ready)
    counted = None
    for turn in range(TURNS):
        both = words.where(turn_of == turn).select("stretch", F.lit(False).alias("pair"), F.col("j").alias("i"), F.col("c").alias("x"), F.lit(False).alias("own"))
        for some in replies:
            both = both.unionByName(some.where(F.col("turn") == turn).select("stretch", F.lit(True).alias("pair"), "i", F.col("r").alias("x"), "own"))
        mine = codes.where(F.col("turn") == turn).drop("turn").groupBy("stretch")
        part = staged(mine.cogroup(both.groupBy("stretch")).applyInArrow(lambda left, right: _count(left, right, inner), ready), f"counted{turn}", "zstd", "kind")
        counted = part if counted is None else counted.unionByName(part)
        for done in (codes, *replies):
            remove(spark, f"{done.stage_path}/turn={turn}")
    counts = [0] * (K + 1)
    for i, n in counted.where("kind = 'stats'").select(F.posexplode("low")).groupBy("pos").agg(F.sum("col")).collect():
        counts[i] = int(n)
    d = discounts(counts)
    histories = staged(backoff(counted.where("kind = 'history'").select("v", *_LOW, "big", "below"), d, slots), "histories")
    first = histories.where(F.col("v") == _START).select("whole", "alpha").first() or (0.0, 0.0)
    start = (float(first[0]), float(first[1]))
    values = staged(words.join(histories, words.w == histories.v).select("stretch", "j", "whole", "alpha"), "values", "zstd")
    discard(words, histories)
    texts = counted.where("kind = 'texts'").drop("kind", "v", *_LOW, "big", "below")
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ready_out = spark.createDataFrame([], out).schema
    inner_out = to_arrow_schema(ready_out)
    return texts.groupBy("stretch").cogroup(values.groupBy("stretch")).applyInArrow(lambda left, right: _finish(left, right, inner_out, start, d, slots, train), ready_out)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
