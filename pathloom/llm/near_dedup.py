"""MinHash near-dedup with fast similarity sketches, banding, and exact checks of shingle sets.

A sketch throws the shingles of a text into bins, round after round: in round i < T every
shingle goes to a hashed bin, from round T on all go to bin i - T, so that each bin is
filled after 2T rounds at the latest; a bin keeps its least (round, hash). The share of
equal bins estimates the Jaccard similarity with the concentration of independent draws.

Equal sets are one node. Nodes that share a band are candidates, and each link is confirmed
on the whole sets. Links within a band are not all tried: in rounds each node is tried with
a few centres of the buckets it shares, and what links is contracted. When rounds link little,
only pairs of different components are left, and all of those are tried.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import npbytes as nb
from .common import aside, discard, row_key, staged, table, text_or_empty
from .components import components

SHINGLE, PERCENT = 5, 75
#: A pair at the threshold shares no band with probability (1 - 0.75 ** ROWS) ** BANDS, 1.3e-6.
BANDS, ROWS = 50, 5
T = BANDS * ROWS
#: Centres of a bucket in a later round, and how many a node tries; a round that links fewer than one in YIELD of its pairs is the last.
CENTRES, YIELD = 4, 8
#: Bins of the finer sketch, of one bit each, that pairs of what is left must pass; and the bits that may differ:
#: at the threshold 1/8 of them do, and a deviation of 5 standard errors has probability 3e-7.
FINE = 4096
MAX_DIFFER = int(FINE / 8 + 5 * (FINE * 7 / 64) ** 0.5)
_WORDS = [f"f{k}" for k in range(FINE // 64)]
#: Words of FINE bits that tell, for each value of a hash, whether a set has an odd number of members of that value. Two sets differ in no more bits
#: than members, so this bound loses no link; up to some 500 members it is nearly the exact number.
_ODD = [f"o{k}" for k in range(FINE // 64)]
_CHUNK = 3 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(column) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = nb.buffers(column)
    for i, j in nb.groups(offsets, _CHUNK):
        part, off = nb.lower_az(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        starts, ends, first = nb.words(part, off)
        h = nb.word_hashes(part, starts, ends)
        runs = nb.runs_hash(h, SHINGLE)
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= SHINGLE:
                yield np.unique(runs[a : b - SHINGLE + 1])
            elif b > a:
                yield nb.runs_hash(h[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t bins for each set; all sets have members."""
    n = len(sets)
    bins = np.full(n * t, _NONE, np.uint64)
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        if not len(items):
            break
        v = nb.mix(items + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(i) << np.uint64(48)) | (v & _LOW)
        if i < t:
            place = ((v >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)
        else:
            place = np.full(len(items), i - t, np.uint64)
        np.minimum.at(bins, owner * t + place.astype(np.int64), value)
        full = (bins.reshape(n, t) != _NONE).all(axis=1)
        left = ~full[owner]
        items, owner = items[left], owner[left]
    return bins.reshape(n, t)


def band_keys(bins: np.ndarray) -> np.ndarray:
    bands = bins.reshape(len(bins), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bins), BANDS)).copy()
    for k in range(ROWS):
        out = nb.mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return out


def _node(shingles: np.ndarray) -> int:
    """The name of a set: equal sets are one node."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            sets = list(shingle_sets(some.column("text")))
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = band_keys(sketches([sets[k] for k in full])) if full else np.zeros((0, BANDS), np.uint64)
            sizes = np.zeros(len(sets) + 1, np.int32)
            sizes[[k + 1 for k in full]] = BANDS
            node = [_node(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("rid"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(nb.as_long(keys.ravel())))],
                names=["doc_id", "rid", "node", "n_shingles", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that gave their node."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            pairs = zip(some.column("node").to_pylist(), shingle_sets(some.column("text")), strict=True)
            own = [(node, s.tobytes()) for node, s in pairs if len(s) and _node(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], names=["node", "shingles"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit of each bin of a sketch of FINE bins, and the parities of the members by FINE values, in 64-bit words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in some.column("shingles")]
            bits = np.packbits((sketches(sets, FINE) & np.uint64(1)).astype(bool), axis=1).view(np.int64)
            counts = np.stack([np.bincount((nb.mix(s) % np.uint64(FINE)).astype(np.int64), minlength=FINE) for s in sets])
            odd = np.packbits((counts & 1).astype(bool), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([some.column("node"), *(pa.array(x[:, k]) for x in (bits, odd) for k in range(FINE // 64))], names=["node", *_WORDS, *_ODD])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(p) + len(q) - len(np.union1d(p, q))
            linked.append(100 * common >= PERCENT * (len(p) + len(q) - common))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    return staged(pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "links")


def _sizes_fit(n, m):
    return F.lit(100) * F.least(n, m) >= F.lit(PERCENT) * F.greatest(n, m)


def _merged(frame: DataFrame, joined: DataFrame, name: str) -> DataFrame:
    """``frame`` with its labels carried on to those of ``joined`` (node: an old label, label: the new one)."""
    to = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return staged(frame.join(to, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), name)


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold two components or more."""
    mixed = staged(members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket"), "mixed")
    return staged(members.join(mixed, "bucket", "left_semi"), "open_members")


def _centres(members: DataFrame, turn: int) -> DataFrame:
    """(bucket, centre, m, of): the least node of each bucket, then the greatest, then CENTRES others by seeded hashes."""
    one = F.struct("node", "n_shingles", "label")
    if turn < 2:
        picks = [(F.min, F.max)[turn](one)]
    else:
        picks = [F.min_by(one, F.xxhash64("node", F.lit(CENTRES * turn + k))) for k in range(CENTRES)]
    found = members.groupBy("bucket").agg(F.array_distinct(F.array(*picks)).alias("cs")).select("bucket", F.explode("cs").alias("c"))
    return found.select("bucket", F.col("c.node").alias("centre"), F.col("c.n_shingles").alias("m"), F.col("c.label").alias("of"))


def components_of(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, label) of the nodes that share a bucket, from rows (rid, node, n_shingles, bands) and the texts: equal labels are linked.

    Rounds: each node is tried with the centres that it shares most buckets with, and what links is contracted, until a
    round links less than one in YIELD of what it tries. Only pairs of different components go on to the last step, which
    tries all that are left.
    """
    nodes = staged(signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("rid", "n_shingles", "bands")).alias("m")).select("node", "m.*"), "nodes")
    spread = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = staged(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "buckets")
    members = staged(spread.join(shared, "bucket", "left_semi"), "members")
    asked = members.select("node").distinct().join(nodes.select("node", "rid"), "node")
    sets = docs.select(text_or_empty().alias("text"), row_key().alias("rid")).join(asked, "rid").mapInArrow(_sets, "node long, shingles binary")
    sets = staged(sets.dropDuplicates(["node"]), "sets")

    discard(shared)
    labels = staged(sets.select("node", F.col("node").alias("label")), "labels")
    members = staged(members.withColumn("label", F.col("node")), "members")
    tried: DataFrame | None = None
    for turn in count():
        centres = staged(_centres(members, turn), "centres")
        pairs = members.join(centres, "bucket").where((F.col("label") != F.col("of")) & _sizes_fit(F.col("n_shingles"), F.col("m")))
        pairs = pairs.groupBy("node", "centre", "label", "of").agg(F.count("*").alias("shares"))
        place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("shares"), "centre"))  # of 50 buckets' centres at most
        pairs = pairs.withColumn("_k", place).where(F.col("_k") <= (1 if turn < 2 else CENTRES))
        best = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        if tried is not None:
            best = best.join(tried, ["a", "b"], "left_anti")
        best = staged(best, "pairs")
        tried = best if tried is None else tried.unionByName(best)
        found = _linked(best, sets)
        n_tried, n_found = best.count(), found.count()
        old = [centres, found]
        if n_found:
            joined = components(_by_label(found, labels))
            old += [labels, members, joined]
            labels, members = _merged(labels, joined, "labels"), _merged(members, joined, "members")
        old.append(members)
        members = _open(members)
        discard(*old)
        if turn >= 2 and n_found * YIELD <= n_tried:
            break

    # What is left: in each bucket all members of other components than its largest, with all members. A pair
    # is tried where its finer sketches and parities allow it, and in the first bucket that it shares.
    fine = sets.join(members.select("node").distinct(), "node").mapInArrow(_fine, "node long, " + ", ".join(f"{w} long" for w in [*_WORDS, *_ODD]))
    known = staged(fine.join(nodes.select("node", "bands"), "node"), "fine")
    sizes = members.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("m")).select("bucket", F.col("m.label").alias("main"))
    members = staged(members.join(staged(sizes, "main"), "bucket").join(known, "node").withColumn("before", F.slice("bands", 1, F.array_position("bands", F.col("bucket")).cast("int") - 1)).drop("bands"), "left")
    few = members.where("label <> main")
    u, v = few.alias("u"), members.alias("v")
    differ, least = (sum((F.bit_count(F.col(f"u.{w}").bitwiseXOR(F.col(f"v.{w}"))) for w in words), F.lit(0)) for words in (_WORDS, _ODD))
    near = F.lit(100 + PERCENT) * least <= F.lit(100 - PERCENT) * (F.col("u.n_shingles") + F.col("v.n_shingles"))
    pairs = u.join(v, (F.col("u.bucket") == F.col("v.bucket")) & (F.col("u.label") != F.col("v.label")) & ((F.col("v.label") == F.col("v.main")) | (F.col("u.node") < F.col("v.node")))
                   & _sizes_fit(F.col("u.n_shingles"), F.col("v.n_shingles")) & near & (differ <= MAX_DIFFER) & ~F.arrays_overlap("u.before", "v.before"))
    rest = pairs.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return _merged(labels, components(_by_label(_linked(staged(rest, "rest"), sets), labels)), "labels")


def _by_label(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) of nodes as distinct links of their labels."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end)
    return links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def _verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, rid, label (null without a set), n_shingles, component_id and kept of every row of ``docs``: one row of each label is kept."""
    keyed = docs.select("doc_id", text_or_empty().alias("text"), row_key().alias("rid"))
    signed = keyed.mapInArrow(_sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid long, node long, n_shingles long, bands array<long>")
    signed = staged(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    labels = components_of(signed, docs)
    rows = signed.select("doc_id", "rid", "row", "n_shingles", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = staged(rows, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid", "row")
    least = staged(rows.where("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("first")), "least")
    out = rows.join(least, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")))
    return out.select("doc_id", "rid", "label", "n_shingles", "component_id", (F.col("label").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text, ...).

    Words are lower-cased (A-Z); a text's set is its distinct runs of SHINGLE words, or its only
    shorter run; null, empty and wordless texts have no set, link with nothing, and keep
    themselves. Texts link at PERCENT of their union; component_id is the least doc_id that links
    reach, null only where none of them has one. Equal sets always link. One row of each component
    is kept: the least by doc_id (nulls last), then by a hash of doc_id and text; of equal rows, any one.
    """
    return _verdicts(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their component keeps, all columns as they are; of kept rows equal in doc_id and text, one."""
    docs, back = aside(docs, "doc_id", "text")
    rows = staged(_verdicts(docs).select("rid", "label", "kept"), "verdicts")
    kept = rows.where("kept").select(F.col("rid").alias("_rid")).distinct()
    repeated = rows.where("label IS NOT NULL").groupBy("rid").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    repeated = staged(repeated.where("kept AND n > 1").select(F.col("rid").alias("_rid")), "repeated")
    out = docs.withColumn("_rid", row_key()).join(kept, "_rid", "left_semi")
    if not repeated.isEmpty():
        out = out.join(repeated, "_rid", "left_anti").unionByName(out.join(repeated, "_rid", "left_semi").dropDuplicates(["_rid"]))
    return back(out)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
