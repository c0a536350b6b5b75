"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds a block of benchmark items of at most BLOCK_WORDS words, so what a
task loads is bounded; further blocks are further map steps of the same Spark stage, and
documents are never shuffled. Numpy finds the stretches of words that the block's
vocabulary knows; only those are walked through the automaton.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import npbytes as nb
from .common import aside, table, without

WINDOW, MIN_SHARE_PERCENT = 13, 5
#: Words of benchmark items in one automaton: about 30 MB in a task. Items beyond it go to another block.
BLOCK_WORDS = 50_000
_CHUNK = 1 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class SuffixAutomaton:
    """Of all items' word sequences; no match crosses items. States know the items that their strings occur in."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        items = [(name, h) for name, h in items if len(h)]
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.width = len(self.vocabulary) + 1
        self.shortest = min([window, *(len(h) for _, h in items)])
        self.next: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        outgoing: list[list[int]] = [[]]
        paths = []
        for name, h in items:
            ids = (np.searchsorted(self.vocabulary, h) + 1).tolist()
            last = 0
            for c in ids:
                last = self._extend(last, c, outgoing)
            paths.append((name, ids))
        self._mark(paths)

    def _extend(self, last: int, c: int, outgoing: list[list[int]]) -> int:
        nxt, length, link, w = self.next, self.length, self.link, self.width

        def clone(p: int, q: int) -> int:
            k = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            outgoing.append(list(outgoing[q]))
            for x in outgoing[q]:
                nxt[k * w + x] = nxt[q * w + x]
            link[q] = k
            while p >= 0 and nxt.get(p * w + c) == q:
                nxt[p * w + c] = k
                p = link[p]
            return k

        q = nxt.get(last * w + c)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        outgoing.append([])
        p = last
        while p >= 0 and (p * w + c) not in nxt:
            nxt[p * w + c] = new
            outgoing[p].append(c)
            p = link[p]
        if p >= 0:
            q = nxt[p * w + c]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def _mark(self, paths: list[tuple[str, list[int]]]) -> None:
        n, w = len(self.length), self.window
        at: list[list[str]] = [[] for _ in range(n)]  # items with a string of the state, for states of a window's length or more
        short: list[tuple[tuple[int, str], ...]] = [()] * n
        for name, ids in paths:
            v = 0
            for c in ids:
                v = self.next[v * self.width + c]
                u = v
                while u > 0 and self.length[u] >= w and (not at[u] or at[u][-1] != name):
                    at[u].append(name)
                    u = self.link[u]
            if len(ids) < w:
                short[v] = (*short[v], (len(ids), name))
        #: The state that holds the window's suffix of a state's strings.
        self.root = [0] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.root[v] = v if self.length[v] >= w > self.length[up] else self.root[up] if self.length[v] >= w else 0
            short[v] = short[v] + short[up]
        self.items = {v: tuple(at[v]) for v in range(n) if at[v] and self.root[v] == v}
        self.short = {v: x for v, x in enumerate(short) if x}

    def walk(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words covered by windows that occur, one for each match, and the items of those windows."""
        nxt, length, link, width, w = self.next, self.length, self.link, self.width, self.window
        v = n = 0
        spans, found = [], set()
        for i, c in enumerate(ids):
            to = nxt.get(v * width + c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt.get(v * width + c)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= w:
                spans.append((i + 1 - w, i + 1))
                found.update(self.items[self.root[v]])
            for m, name in self.short.get(v, ()):
                if m <= n:
                    spans.append((i + 1 - m, i + 1))
                    found.add(name)
        return spans, found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, offsets = nb.buffers(pa.array(texts, pa.large_string()))
    data = nb.lower_az(data)
    starts, ends, first = nb.words(data, offsets, nb.ALNUM)
    h = nb.word_hashes(data, starts, ends)
    return [h[first[i] : first[i + 1]] for i in range(len(texts))]


def _scan(sam: SuffixAutomaton, column) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its words, the union of hit spans, and the items."""
    data, offsets = nb.buffers(column)
    for i, j in nb.groups(offsets, _CHUNK):
        raw = data[offsets[i] : offsets[j]]
        part, off = nb.lower_az(raw), offsets[i : j + 1] - offsets[i]
        starts, ends, first = nb.words(part, off, nb.ALNUM)
        h = nb.word_hashes(part, starts, ends)
        place = np.minimum(np.searchsorted(sam.vocabulary, h), max(0, len(sam.vocabulary) - 1))
        known = sam.vocabulary[place] == h if len(sam.vocabulary) else np.zeros(len(h), bool)
        begins, stops = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        stops[:-1] &= ~known[1:]
        heads = first[:-1][first[:-1] < first[1:]]
        begins[heads] = known[heads]
        tails = heads[1:] - 1
        stops[tails] = known[tails]
        lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        long_enough = hi - lo >= sam.shortest
        lo, hi = lo[long_enough], hi[long_enough]
        owner = np.searchsorted(first, lo, side="right") - 1
        hits: dict[int, tuple[list, set]] = {}
        for a, b, k in zip(lo.tolist(), hi.tolist(), owner.tolist(), strict=True):
            spans, found = sam.walk((place[a:b] + 1).tolist())
            if spans:
                base = a - int(first[k])
                got = hits.setdefault(k, ([], set()))
                got[0].extend((base + s, base + e) for s, e in spans)
                got[1].update(found)
        for k in range(j - i):
            n = int(first[k + 1] - first[k])
            if k not in hits:
                yield n, [], []
                continue
            yield n, _union(hits[k][0]), sorted(hits[k][1])


def _without(text: str | None, spans: list[dict]) -> str | None:
    """The text without its words [start, end) and what stands between those; None if there are none."""
    if not spans:
        return None
    raw, off = nb.buffers(pa.array([text], pa.large_string()))
    starts, ends, _ = nb.words(nb.lower_az(raw), off, nb.ALNUM)
    at, keep = 0, []
    for s in spans:
        keep.append(raw[at : starts[s["start"]]].tobytes())
        at = int(ends[s["end"] - 1])
    return b"".join([*keep, raw[at:].tobytes()]).decode()


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurring window), item_ids (of those windows), spans
    (hit runs of words [start, end)) and contaminated; with ``cut`` also cut_text, the text without its hit spans.

    ``items`` (item_id, text) are read in blocks; a window is ``window`` consecutive words of
    an item, or a shorter item as a whole. Null or empty texts and items have no words and no
    windows; with no items nothing is hit. Repeated items count as one id each time they share
    it; a null item_id is "null". Columns of ``docs`` with the added names are replaced.
    """
    spark = docs.sparkSession
    added = {"n_words": T.LongType(), "n_hit": T.LongType(), "item_ids": T.ArrayType(T.StringType()), "spans": _SPANS, "contaminated": T.BooleanType()}
    docs, back = aside(without(docs, *added, "cut_text"), "text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    plain = [f.name for f in docs.schema.fields]

    def step(df: DataFrame, block: list[tuple[str, np.ndarray]], again: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = shared.value
            for batch in batches:
                out: dict[str, list] = {k: [] for k in added}
                before = batch.select(["item_ids", "spans"]).to_pylist() if again else [{}] * batch.num_rows
                texts = batch.column("text")
                for row, (n, spans, found) in zip(before, _scan(sam, texts), strict=True):
                    if again:
                        spans = _union([*spans, *((s["start"], s["end"]) for s in row["spans"])])
                        found = sorted({*found, *row["item_ids"]})
                    hit = sum(e - s for s, e in spans)
                    for k, v in zip(added, (n, hit, found, [{"start": s, "end": e} for s, e in spans], hit > 0 and 100 * hit >= MIN_SHARE_PERCENT * n), strict=True):
                        out[k].append(v)
                arrow = {"n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "contaminated": pa.bool_()}
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *(pa.array(v, arrow[k]) for k, v in out.items())], names=[*plain, *added])

        return df.mapInArrow(match, schema)

    block: list[tuple[str, np.ndarray]] = []
    size, out, again = 0, docs, False
    for row in items.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        (h,) = item_words([row[1]])
        if block and size + len(h) > block_words:
            out, again, block, size = step(out, block, again), True, [], 0
        block.append((row[0] if row[0] is not None else "null", h))
        size += len(h)
    out = step(out, block, again)
    if not cut:
        return back(out, *added)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_without(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.string())], names=[*batch.schema.names, "cut_text"])

    return back(out.mapInArrow(shorten, T.StructType([*schema.fields, T.StructField("cut_text", T.StringType())])), *added, "cut_text")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the items do not contaminate, all columns as they are.

    A text whose hit spans reach MIN_SHARE_PERCENT of its words exceeds the coverage limit and
    goes as a whole; texts under it stay untouched.
    """
    docs, back = aside(docs, "text")
    return back(find(docs, items).where(~F.col("contaminated")))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), "contaminated",
    )
