"""Sharding: a minimax contiguous partition of atomic groups (equal texts).

The order of the groups is that of a 64-bit hash of their text, so a prefix of the
hash bits names a block of consecutive groups. The driver only ever holds sums of
blocks: a fixed number of coarse ones, and the finer ones around the cuts, which it
asks Spark for while the search narrows. The shard of a row is then a comparison of
its hash with the cuts, without a shuffle.
"""
from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

SHARDS, OVERHEAD = 40, 16
_COARSE, _FINER = 12, 8
#: Rows that one bucket of the slot numbering is meant for.
SLOT_ROWS = 20_000
_OFFSET = 1 << 63


class _Blocks:
    """Consecutive blocks of groups: [lo, hi] in hash order, with their bytes. Blocks of one group are atomic."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.items = [(lo + _OFFSET, hi + _OFFSET, size, _COARSE) for lo, hi, size in self._sums(rows, _COARSE)]
        self._index()

    @staticmethod
    def _sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int]]:
        # Spark compares signed; flipping the sign bit gives the same order as unsigned prefixes.
        prefix = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-_OFFSET)), 64 - bits) if bits < 64 else F.col("h")
        found = rows.groupBy(prefix.alias("p")).agg(F.min("h"), F.max("h"), F.sum("size")).collect()
        return sorted((r[1], r[2], int(r[3])) for r in found)

    def _index(self) -> None:
        self.ends = list(accumulate(size for _, _, size, _ in self.items))

    def atomic(self, k: int) -> bool:
        return self.items[k][0] == self.items[k][1]

    def refine(self, ks: set[int]) -> None:
        """Replace the blocks ``ks`` by their finer ones, one Spark job for each level."""
        for bits in sorted({self.items[k][3] for k in ks}):
            chosen = [self.items[k] for k in ks if self.items[k][3] == bits]
            prefix = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-_OFFSET)), 64 - bits)
            finer = min(64, bits + _FINER)
            asked = self.rows.where(prefix.isin([lo >> (64 - bits) for lo, _, _, _ in chosen]))
            gone = set(chosen)
            self.items = [x for x in self.items if x not in gone]
            self.items += [(lo + _OFFSET, hi + _OFFSET, size, finer) for lo, hi, size in self._sums(asked, finer)]
        self.items.sort()
        self._index()

    def cuts(self, capacity: int, n: int, start: int = 0) -> tuple[list[int], set[int]]:
        """Greedy: how far each shard gets with ``capacity``, at most n + 1 shards; and the blocks that a cut falls into."""
        out, inside, base = [start], set(), self.ends[start - 1] if start else 0
        while out[-1] < len(self.items) and len(out) <= n + 1:
            k = bisect_right(self.ends, base + capacity)
            if k < len(self.items) and not self.atomic(k):
                inside.add(k)
            if k == out[-1]:  # not even one block fits
                return [*out, *[k] * (n + 2)], inside
            base = self.ends[k - 1]
            out.append(k)
        return out, inside


def _smallest(blocks: _Blocks, n: int, least: int) -> int:
    total = blocks.ends[-1]
    lo, hi = least, total
    while lo < hi:
        mid = (lo + hi) // 2
        if len(blocks.cuts(mid, n)[0]) <= n + 1:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _balanced(blocks: _Blocks, capacity: int, n: int) -> tuple[list[int], set[int]]:
    """Cuts within ``capacity`` that stay near equal shares of what is left, if what follows still fits."""
    out, inside, at, total = [], set(), 0, blocks.ends[-1]
    for left in range(n, 1, -1):
        base = blocks.ends[at - 1] if at else 0
        k = bisect_right(blocks.ends, base + (total - base) / left)
        if k < len(blocks.items) and not blocks.atomic(k):
            inside.add(k)
        most = bisect_right(blocks.ends, base + capacity)
        tries = sorted({min(k, most), min(k + 1, most)}, key=lambda j: abs((blocks.ends[j - 1] if j else 0) - base - (total - base) / left))
        for j in (*(j for j in tries if j > at), most):
            if len(blocks.cuts(capacity, left - 1, j)[0]) <= left:
                break
        at = j
        out.append(at)
    return out, inside


def boundaries(rows: DataFrame, n: int) -> tuple[list[int], int]:
    """The first hash of shards 1 to n-1 and the capacity, from rows (h, size). Exact: blocks are refined until every cut lies between groups."""
    most = rows.groupBy("h").agg(F.sum("size").alias("size")).agg(F.max("size"), F.sum("size")).first()
    if most[0] is None:
        return [], 0
    least = max(int(most[0]), -(-int(most[1]) // n))
    blocks = _Blocks(rows)
    while True:
        capacity = _smallest(blocks, n, least)
        _, open_ = blocks.cuts(capacity, n)
        if capacity > least:
            open_ = open_ | blocks.cuts(capacity - 1, n)[1]
        cuts, inside = _balanced(blocks, capacity, n) if not open_ else ([], set())
        if not open_ | inside:
            return [blocks.items[k][0] - _OFFSET if k < len(blocks.items) else _OFFSET - 1 for k in cuts], capacity
        blocks.refine(open_ | inside)


def shard(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, ...) into one of ``n`` shards by the law ``bytes``.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot (gapless from 0
    in each shard), grown_shard (null: this law does not promise stable growth).
    Null texts count as empty, and form one group with the empty ones. Equal texts stay
    together, however many; no other partition of the hash order into ``n`` runs has a
    smaller largest shard. Repeated and null doc_ids are kept as rows of their own. With
    fewer groups than shards, or no rows, shards stay empty. Other columns are ignored.
    """
    narrow = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
            F.xxhash64(text_or_empty()).alias("h"),
        ),
        "sizes",
    )
    cuts, _ = boundaries(narrow.select("h", "size"), n)
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col("h") >= F.lit(cut)).cast("int")
    salt = max(32, -(-narrow.count() // (n * SLOT_ROWS)))
    placed = narrow.withColumn("shard", place).withColumn("_b", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salt)).cast("int"))
    # Slots: rank within a bucket of the shard plus the rows of the buckets before; no shard goes through one task.
    before = placed.groupBy("shard", "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.partitionBy("shard").orderBy("_b")) - F.col("_n"))
    ranked = placed.withColumn("_r", F.row_number().over(W.partitionBy("shard", "_b").orderBy("doc_id", "h")))
    return ranked.join(before, ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_shard(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
