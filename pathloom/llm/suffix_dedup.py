"""Suffix-array dedup: which LENGTH-byte strings start at more than one place.

Prefix doubling over every byte would sort each position several times, many times the
size of the corpus. Here it runs over anchors: the position of the least CORE-byte hash
of every window of LENGTH bytes (winnowing), about one position in 170, chosen by content
alone, so that equal windows have equal anchors. Ranks are equality classes that Spark
groups, at growing lengths:

* round 0: classes of anchors with the same CORE bytes; unique ones end here. A class is
  split by its hull, all bytes that windows through the anchor can reach; equal hulls
  settle every window of both at once;
* later rounds: the windows through an unsettled anchor start at up to 343 = 7^3 offsets
  before it. Blocks of 49, 7 and then 1 of them have cores of 352, 394 and 400 bytes. A
  block whose core is unique ends, one whose hull has a twin is settled, and others are
  split in the next round. At 400 bytes the answer is exact.

A class passes on one member, so a group of copies costs one row after round 0.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npbytes as nb
from .common import discard, staged, table, text_or_empty

LENGTH, BRANCH, ROUNDS = 400, 7, 3
#: Starts of windows through an anchor; bytes that all of them share.
STARTS = BRANCH**ROUNDS
CORE = LENGTH - STARTS + 1
_CHUNK = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.full(_CHUNK + 2, _MULT, np.uint64))
_DOWN = np.cumprod(np.full(_CHUNK + 2, pow(_MULT, -1, 1 << 64), np.uint64))


def _least_places(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of the least CORE-byte hash in each window [p, p + LENGTH) with valid[p]; ties go left."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(nb._SEED[data] * _UP[:n], out=sums[1:])
    m = n - CORE + 1
    h = nb.mix((sums[CORE:] - sums[:m]) * _DOWN[:m])
    h = (h & ~np.uint64((1 << 21) - 1)) | np.arange(m, dtype=np.uint64)  # the place breaks ties, and comes out with the least
    rows = -(-m // STARTS)
    blocks = np.full(rows * STARTS, np.iinfo(np.uint64).max, np.uint64)
    blocks[:m] = h
    blocks = blocks.reshape(rows, STARTS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.flatnonzero(valid)
    least = np.minimum(behind[p], ahead[p + STARTS - 1])
    return np.unique(least & np.uint64((1 << 21) - 1)).astype(np.int64)


def _anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, places) for each text of LENGTH bytes or more."""
    for i, j in nb.groups(offsets, _CHUNK):
        base, size = offsets[i], int(offsets[j] - offsets[i])
        if size > _CHUNK:  # one long text, in stretches that share LENGTH - 1 bytes
            found = []
            for at in range(0, size - LENGTH + 1, _CHUNK - LENGTH + 1):
                part = data[base + at : min(base + at + _CHUNK, offsets[j])]
                found.append(_least_places(part, np.ones(len(part) - LENGTH + 1, bool)) + at)
            yield i, np.unique(np.concatenate(found))
            continue
        if size < LENGTH:
            continue
        part, off = data[base : offsets[j]], offsets[i : j + 1] - base
        starts = np.zeros(size + 1, np.int64)
        sizes = np.diff(off)
        long = sizes >= LENGTH
        np.add.at(starts, off[:-1][long], 1)
        np.add.at(starts, off[1:][long] - LENGTH + 1, -1)
        places = _least_places(part, np.cumsum(starts)[: size - LENGTH + 1] > 0) if long.any() else np.zeros(0, np.int64)
        first = np.searchsorted(places, off)
        for k in np.flatnonzero(first[:-1] < first[1:]):
            yield i + int(k), places[first[k] : first[k + 1]] - off[k]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code, wide = xxhash.xxh3_64_intdigest, 1 << 63
    for batch in batches:
        rid = batch.column("rid").to_pylist()
        data, offsets = nb.buffers(batch.column("text"))
        out: list[list] = [[] for _ in range(6)]
        for row, places in _anchors(data, offsets):
            begin, n = int(offsets[row]), int(offsets[row + 1] - offsets[row])
            raw = data[begin : begin + n].tobytes()
            for a in places.tolist():
                x, y = max(0, a + LENGTH - n), min(STARTS - 1, a)
                for column, value in zip(out, (code(raw[a : a + CORE]) - wide, code(raw[a - y : a - x + LENGTH], 1) - wide, rid[row], a, x, y), strict=True):
                    column.append(value)
            if len(out[0]) > 50_000:
                yield _rows(out)
                out = [[] for _ in range(6)]
        yield _rows(out)


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["core", "hull", "rid", "pos", "x", "y"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that windows through each asked anchor can reach."""
    names = ["core", "rid", "pos", "x", "y", "need", "bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.binary())
    for batch in batches:
        data, offsets = nb.buffers(batch.column("text"))
        out: list[list] = [[] for _ in names]
        for k, (rid, asked) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
            raw = data[offsets[k] : offsets[k + 1]]
            for r in asked:
                a, x, y = r["pos"], r["x"], r["y"]
                for column, value in zip(out, (r["core"], rid, a, x, y, r["need"], raw[a - y : a - x + LENGTH].tobytes()), strict=True):
                    column.append(value)
            if len(out[0]) > 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def _split(size: int):
    """A function that splits each asked block (bx, need) of BRANCH * size starts into blocks of ``size``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "rid", "pos", "bx", "need", "core2", "hull", "cx", "cy"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.bool_(), pa.int64(), pa.int64(), pa.int16(), pa.int16())
        code, wide = xxhash.xxh3_64_intdigest, 1 << 63
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                a = r["y"]  # the anchor's place in its own bytes
                for b in r["asked"]:
                    for bx in range(b["bx"], b["bx"] + BRANCH * size, size):
                        by = bx + size - 1
                        cx, cy = max(bx, r["x"]), min(by, r["y"])
                        if cx > cy:
                            continue
                        row = (r["core"], r["rid"], r["pos"], bx, b["need"], code(r["bytes"][a - bx : a - by + LENGTH], bx) - wide, code(r["bytes"][a - cy : a - cx + LENGTH], 1) - wide, cx, cy)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return split


def _unsettled(classes: DataFrame, core: list[str]) -> DataFrame:
    """Members of ``classes`` (one each) in cores of two classes or more that have one in need."""
    open_ = staged(classes.groupBy(*core).agg(F.count("*").alias("_c"), F.max("need").alias("_f")).where("_c > 1 AND _f").select(*core), "cores")
    return staged(classes.join(open_, core, "left_semi"), "members")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, lo, hi) of bytes covered by repeated strings, from rows (rid, text); spans overlap and repeat."""
    found = staged(docs.mapInArrow(_find_anchors, "core long, hull long, rid long, pos int, x short, y short"), "anchors")
    cores = staged(found.groupBy("core").count().where("count > 1").select("core"), "shared")
    every, found = found, staged(found.join(cores, "core", "left_semi"), "candidates")
    discard(every, cores)

    key = ["core", "hull", "x", "y"]
    classes = staged(found.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("m")), "classes")
    span = [(F.col("pos") - F.col("y")).alias("lo"), (F.col("pos") - F.col("x") + LENGTH).alias("hi")]
    spans = [staged(found.join(classes.where("n > 1").select(*key), key, "left_semi").select("rid", *span).distinct(), "spans")]
    discard(found)

    members = _unsettled(classes.select("core", "x", "y", "m.rid", "m.pos", (F.col("n") == 1).alias("need")), ["core"])
    asked = members.groupBy("rid").agg(F.collect_list(F.struct("core", "pos", "x", "y", "need")).alias("asked"))
    reach = staged(docs.join(asked, "rid").mapInArrow(_contexts, "core long, rid long, pos int, x short, y short, need boolean, bytes binary"), "contexts")
    parts = reach.withColumn("asked", F.array(F.struct(F.lit(0).cast("short").alias("bx"), "need")))
    for k in range(1, ROUNDS + 1):
        size = BRANCH ** (ROUNDS - k)
        rows = staged(parts.drop("need").mapInArrow(_split(size), "core long, rid long, pos int, bx short, need boolean, core2 long, hull long, cx short, cy short"), f"blocks{size}")
        key = ["core", "core2", "bx", "hull", "cx", "cy"]
        classes = staged(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("m"), F.max("need").alias("need")), f"classes{size}")
        twins = classes.where("n > 1 AND need").select(*key)
        covered = rows.where("need").join(twins, key, "left_semi").select("rid", (F.col("pos") - F.col("cy")).alias("lo"), (F.col("pos") - F.col("cx") + LENGTH).alias("hi"))
        spans.append(staged(covered, f"spans{size}"))
        discard(rows)
        if size == 1:
            break
        single = classes.select("core", "core2", "bx", "m.rid", "m.pos", ((F.col("n") == 1) & F.col("need")).alias("need"))
        members = _unsettled(single, ["core", "core2", "bx"]).groupBy("rid", "pos").agg(F.collect_list(F.struct("bx", "need")).alias("asked"))
        parts = reach.join(members, ["rid", "pos"])
    discard(reach)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = nb.buffers(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        out: list[list] = [[], [], [], []]
        kept_all = []
        for k, some in enumerate(spans):
            raw = data[offsets[k] : offsets[k + 1]].tobytes()
            at, keep, n = 0, [], 0
            for lo, hi in sorted((s["lo"], min(s["hi"], len(raw))) for s in some or ()):
                if lo > at or (lo == 0 and not n):  # a new run; touching runs are one
                    keep.append(raw[at:lo])
                    n += 1
                at = max(at, hi)
            keep.append(raw[at:])
            kept = b"".join(keep)
            for column, value in zip(out, (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
            kept_all.append(kept)
        columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts:
            columns.append(pa.array(kept_all, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: bytes covered by a LENGTH-byte string
    that also starts elsewhere are removed (all occurrences, overlaps count); with ``texts`` also kept (binary,
    as a cut may fall inside a character).

    Null texts are empty. Texts under LENGTH bytes lose nothing. A row that repeats doc_id and text
    is another text, so both lose all from LENGTH bytes on. Rows are told apart by a 64-bit key of
    doc_id and text; further columns are ignored. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    twins = rows.groupBy("rid").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"n > 1 AND size >= {LENGTH}")
    spans = repeated_spans(rows.select("rid", "text")).unionByName(twins.select("rid", F.lit(0).alias("lo"), F.col("size").cast("int").alias("hi")))
    spans = staged(spans.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(lambda batches: _cut(batches, texts), fields)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
