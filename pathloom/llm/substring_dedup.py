"""Substring dedup over runs of sentences: every run is hashed, joined with all others, and
sentences inside a run that started earlier elsewhere are removed."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npbytes as nb
from .common import staged, table, text_or_empty

#: A sentence ends at a line's end or a word with one of the marks. Of any PIECE neighbouring places inside a sentence, it is cut
#: at the one whose two words have the least hash: cuts depend on the words around them only, so a passage gets the same ones
#: wherever it stands, PIECE words from its ends. A run is the fewest sentences, MIN_SENTENCES at least, that have MIN_WORDS words together.
PIECE, MIN_SENTENCES, MIN_WORDS = 6, 2, 25
_MARKS = nb.byte_class(b".!?")
_WIDE_MARKS = [m.encode() for m in "。！？｡．…؟۔।॥‼⁇⁈⁉"]
_CHUNK = 2 << 20
_MULT = 0x9E3779B97F4A7C15
_DOWN = np.cumprod(np.full(4096, pow(_MULT, -1, 1 << 64), np.uint64))


def _inverse_powers(n: int) -> np.ndarray:
    global _DOWN
    if n > len(_DOWN):
        _DOWN = np.cumprod(np.full(1 << int(n).bit_length(), pow(_MULT, -1, 1 << 64), np.uint64))
    return _DOWN


def _marked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words that end at ``ends`` end with a mark."""
    out = _MARKS[data[ends - 1]]
    wide = np.flatnonzero(data[ends - 1] >= 0x80)
    for mark in _WIDE_MARKS:
        same = np.ones(len(wide), bool)
        for back, byte in enumerate(reversed(mark), 1):
            same &= data[np.maximum(ends[wide] - back, 0)] == byte
        out[wide] |= same
    return out


def _cuts(new: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places inside sentences (which begin at ``new``) that have the least hash of some PIECE in a row, the first of equal ones."""
    n = len(h)
    out = np.zeros(n, bool)
    if n <= PIECE:
        return out
    v = np.empty(n, np.uint64)
    v[0], v[1:] = 0, nb.mix(h[:-1] * np.uint64(_MULT) + h[1:])
    windows = np.lib.stride_tricks.sliding_window_view(v, PIECE)
    inside = ~np.lib.stride_tricks.sliding_window_view(new, PIECE).any(axis=1)
    at = np.flatnonzero(inside)
    out[at + windows[at].argmin(axis=1)] = True
    return out


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of the sentences (with the number of words at the end), the first sentence of each text, and the words' starts and hashes."""
    starts, ends, first = nb.words(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), starts, np.zeros(0, np.uint64)
    lines = np.cumsum(data == 10)
    new = np.ones(n, bool)
    new[1:] = _marked(data, ends[:-1]) | (lines[starts[1:]] != lines[ends[:-1] - 1])
    new[first[:-1][first[:-1] < n]] = True
    h = nb.word_hashes(nb.lower_az(data), starts, ends)
    heads = np.flatnonzero(new | _cuts(new, h))
    return np.append(heads, n), np.searchsorted(heads, first), starts, h


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence, sentences, hash) of every run."""
    heads, first, _, h = _sentences(data, offsets)
    m = len(heads) - 1
    if not m:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    within = np.arange(len(h)) - np.repeat(heads[:-1], np.diff(heads))
    one = nb.mix(np.add.reduceat(h * nb._powers(PIECE)[within], heads[:-1]))
    up, down = nb._powers(m + 1), _inverse_powers(m + 1)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(one * up[:m], out=sums[1:])
    i = np.arange(m)
    j = np.maximum(np.searchsorted(heads, heads[:-1] + MIN_WORDS), i + MIN_SENTENCES)
    text = np.searchsorted(first, i, side="right") - 1
    whole = j <= first[text + 1]
    i, j, text = i[whole], j[whole], text[whole]
    return text, i - first[text], j - i, nb.mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = nb.buffers(batch.column("text"))
        for a, b in nb.groups(offsets, _CHUNK):
            text, at, n, h = _runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows = pa.array(text + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nb.as_long(h)), batch.column("doc_id").take(rows), batch.column("rid").take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16))],
                names=["h", "doc_id", "rid", "at", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = nb.buffers(batch.column("text"))
        out: list[list] = [[], [], []]
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            raw = data[offsets[k] : offsets[k + 1]]
            heads, _, starts, _ = _sentences(raw, np.array([0, len(raw)]))
            m = len(heads) - 1
            if not spans:
                for column, value in zip(out, (m, 0, raw.tobytes().decode()), strict=True):
                    column.append(value)
                continue
            gone = np.zeros(m + 1, np.int64)
            for s in spans:
                gone[s["at"]] += 1
                gone[s["at"] + s["n"]] -= 1
            gone = np.cumsum(gone[:m]) > 0
            edges = np.append(starts[heads[:-1]], len(raw))  # what stands before the first sentence stays
            keep = [raw[: edges[0]].tobytes(), *(raw[edges[s] : edges[s + 1]].tobytes() for s in np.flatnonzero(~gone))]
            for column, value in zip(out, (m, int(gone.sum()), b"".join(keep).decode()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_sentences", "n_removed", "text"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed and text, without the sentences of runs that are found earlier.

    Earlier is by doc_id, then by place; the first of equal runs stays, the same text included.
    Case (A-Z) and white space don't count. Runs need MIN_WORDS words, so texts shorter than that
    stay whole; a sentence of more than PIECE words counts as several. Null texts become
    empty. Rows that repeat doc_id and text get the same answer, as one text; a null doc_id comes
    first. Further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    runs = staged(rows.mapInArrow(_spread, f"h long, doc_id {kind}, rid long, at int, n short"), "runs")
    place = F.struct("doc_id", "rid", "at")
    firsts = staged(runs.groupBy("h").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("h", "first"), "firsts")
    again = runs.join(firsts, "h").where(~place.eqNullSafe(F.col("first")))
    spans = staged(again.groupBy("rid").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_cut, f"doc_id {kind}, n_sentences long, n_removed long, text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))
