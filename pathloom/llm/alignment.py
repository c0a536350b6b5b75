"""Cross-tokenizer alignment by an event sweep.

Each tokenizer turns a text into events, one where each of its tokens ends. The events of
both are united, brought together by document and sorted by offset; a machine then streams
over them. It keeps only the tokens after the last offset at which both tokenizers ended,
and at each such offset gives out a group and the link of the two tokens that end there.
Events travel in blocks of at most BLOCK tokens, as ids from a first offset on: the lengths
of the tokens give the offsets.

A linked pair's bytes end together, so one is the end of the other: there are at most as many
different pairs as the two vocabularies have bytes, whatever the corpus. This bounds the
table of counts, which is sent to every task.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

#: Tokens in a block of events; words that a task remembers; bytes of text that are encoded before their events go out.
BLOCK, WORDS, LOT = 16_384, 300_000, 1 << 22


class Side:
    """A tokenizer: ids of texts, and the bytes of each id. ``kind`` holds ids in files."""

    tokens: list[bytes]

    def finish(self) -> None:
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.kind = np.dtype("<u2") if len(self.tokens) <= 1 << 16 else np.dtype("<u4")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of space+text for each text; none for an empty one."""
        raise NotImplementedError


class Bytes(Side):
    """A byte-level BPE file. Its merges are in the order of their ids, so the ids are ranks; if they weren't, it would be refused."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        real = {*made, *(vocab[c] for c in letters)}  # the rest are special tokens
        ranks = {bytes(letters[c] for c in piece): k for piece, k in vocab.items() if k in real}
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("merges must be in the order of their ids")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.tokens[k] = t
        self._code = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.finish()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._code.encode_ordinary(" " + t) if t else [], np.int64) for t in texts]


class Pieces(Side):
    """A SentencePiece file. Where no piece goes on over a space, words with the spaces before them are coded apart and remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self._code = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._code.id_to_piece(k) for k in range(self._code.vocab_size())]
        self._apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self._word = re.compile(" +[^ ]*")
        self._known: dict[str, int] = {}
        self._flat, self._from = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.tokens = [bytes([int(p[3:5], 16)]) if self._code.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.finish()

    def _learn(self, words: set[str]) -> None:
        new = sorted(words)
        coded = self._code.encode([w[1:] for w in new], num_threads=1)
        # The library adds the space before a word, but none to an empty one: a space at the end of a text is coded after a letter.
        coded = [x if w != " " else self._code.encode("x ")[len(self._code.encode("x")) :] for w, x in zip(new, coded, strict=True)]
        for w in new:
            self._known[w] = len(self._known)
        self._flat = np.concatenate([self._flat, np.array([x for ids in coded for x in ids], np.int64)])
        self._from = np.concatenate([self._from, self._from[-1] + np.cumsum([len(x) for x in coded], dtype=np.int64)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self._apart:
            return [np.array(x, np.int64) for x in self._code.encode(texts, num_threads=1)]
        split = [self._word.findall(" " + t) if t else [] for t in texts]
        new = set().union(*split).difference(self._known)
        if len(self._known) + len(new) > WORDS:
            self._known, self._flat, self._from, new = {}, np.zeros(0, np.int64), np.zeros(1, np.int64), set().union(*split)
        self._learn(new)
        out = []
        for words in split:
            at = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
            sizes = self._from[at + 1] - self._from[at]
            ends = np.cumsum(sizes)
            out.append(self._flat[np.repeat(self._from[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        return out


@lru_cache(maxsize=2)
def side(kind: str, path: str) -> Side:
    """Once for each Python worker; the tasks after reuse it."""
    return (Bytes if kind == "bytes" else Pieces)(path)


def _paths(a: str | None, b: str | None) -> dict[str, tuple[str, str]]:
    import public_tokenizers

    return {"a": ("bytes", a or public_tokenizers.path("byte_bpe_50k.json")), "b": ("pieces", b or public_tokenizers.path("piece_bpe_32k.model"))}


def _end_events(docs: DataFrame, name: str, kind: str, path: str, first: bool) -> DataFrame:
    """(key, at, side, doc_id, ids) of one tokenizer's blocks of events.

    at -1 opens a document (with ``first``) and at -2 marks one whose tokens don't join to space+text.
    """
    number = docs.schema["doc_id"].dataType.simpleString()
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\x1f"), text_or_empty())))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokenizer, pack = side(kind, path), zstandard.ZstdCompressor(level=1)

        def events(texts: list[str]):
            for row, (text, ids) in enumerate(zip(texts, tokenizer.ids(texts), strict=True)):
                if first:
                    yield row, -1, None
                if not text:
                    continue
                if b"".join(map(tokenizer.tokens.__getitem__, ids.tolist())) != b" " + text.encode():
                    yield row, -2, None
                    continue
                starts = np.cumsum(tokenizer.sizes[ids]) - tokenizer.sizes[ids]
                for k in range(0, len(ids), BLOCK):
                    yield row, int(starts[k]), pack.compress(ids[k : k + BLOCK].astype(tokenizer.kind).tobytes())

        for batch in batches:
            texts, begin = [t or "" for t in batch.column("text").to_pylist()], 0
            while begin < batch.num_rows:
                end, size = begin, 0
                while end < batch.num_rows and (size < LOT or end == begin):
                    size, end = size + len(texts[end]), end + 1
                rows, at, ids = zip(*found, strict=True) if (found := list(events(texts[begin:end]))) else ((), (), ())
                taken = batch.slice(begin, end - begin).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("key"), pa.array(at, pa.int64()), pa.array([name] * len(at), pa.string()), taken.column("doc_id"), pa.array(ids, pa.binary())], names=["key", "at", "side", "doc_id", "ids"])
                begin = end

    return docs.select(key.alias("key"), "doc_id", F.col("text")).mapInArrow(code, f"key binary, at long, side string, doc_id {number}, ids binary")


class Machine:
    """What is pending of one document since the last common end, and its sums."""

    def __init__(self, names: list[list[bytes]], width: int):
        self.names, self.width = names, width
        self.whole, self.copies = True, 0
        self.n, self.groups, self.digest = [0, 0], 0, hashlib.sha256()
        self.ids, self.ends, self.covered = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [0, 0]

    def add(self, s: int, at: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        if at < self.covered[s]:
            return  # the same block of an equal row
        ends = at + np.cumsum(sizes[ids])
        self.n[s] += len(ids)
        self.covered[s] = int(ends[-1])
        self.ids[s], self.ends[s] = np.concatenate([self.ids[s], ids]), np.concatenate([self.ends[s], ends])

    def sweep(self) -> tuple[np.ndarray, np.ndarray]:
        """Give out the groups that have ended: different linked pairs and how often each. What comes after the last common end stays."""
        common = np.intersect1d(self.ends[0], self.ends[1], assume_unique=True)
        if not len(common):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = [np.searchsorted(e, common[-1]) + 1 for e in self.ends]
        ids, ends = [x[:k] for x, k in zip(self.ids, cut)], [x[:k] for x, k in zip(self.ends, cut)]
        at = [np.searchsorted(e, common) for e in ends]
        links = ids[0][at[0]] * self.width + ids[1][at[1]]
        # The text of the groups: tokens of group g follow those of g - 1; a comma, bar or semicolon follows each.
        group = [np.searchsorted(common, e) for e in ends]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        marks = [np.zeros(len(x), np.int64) for x in ids]
        marks[0][at[0]], marks[1][at[1]] = 1, 2
        code = np.concatenate([ids[0] * 3 + marks[0], ids[1] * 3 + marks[1]])[order]
        text = b"".join(map(self.names.__getitem__, code.tolist()))
        self.digest.update((b";" if self.groups else b"") + text[:-1])
        self.groups += len(common)
        self.ids, self.ends = [x[k:] for x, k in zip(self.ids, cut)], [x[k:] for x, k in zip(self.ends, cut)]
        return np.unique(links, return_counts=True)

    def result(self) -> tuple:
        n = self.n if self.whole else [0, 0]
        return n[0], n[1], self.groups if self.whole else 0, self.digest.hexdigest() if self.whole and self.groups else ""


_SUMS = ["n_a", "n_b", "n_groups", "groups_sha256"]


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """What the sweep gives out, in rows (key, doc_id, copies, n_a, n_b, n_groups, groups_sha256, pairs, times).

    Every document has one row with its sums, and, if it is long, more rows before it with
    null sums. ``pairs`` are the linked pairs that a row adds, as ``a * width + b`` where
    width is the size of B's vocabulary, ``times`` how often each. Equal rows are swept once: copies says how
    many there are. Documents without tokens have sums of 0, an empty text of groups and no pairs.
    """
    both = _paths(a, b)
    number = docs.schema["doc_id"].dataType.simpleString()
    events = _end_events(docs, "a", *both["a"], first=True).unionByName(_end_events(docs, "b", *both["b"], first=False))
    ordered = events.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "at", "side")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sides, unpack = {x: side(*both[x]) for x in both}, zstandard.ZstdDecompressor()
        width = len(sides["b"].tokens)
        names = [b"%d%c" % (k, mark) for k in range(max(len(s.tokens) for s in sides.values())) for mark in b",|;"]
        machine, now, out = None, None, []

        def close():
            pairs, times = machine.sweep() if machine.whole else ((), ())
            out.append((*now, machine.copies, *machine.result(), pairs, times))

        def flush():
            key, doc, copies, n_a, n_b, groups, digest, pairs, times = zip(*out, strict=True)
            arrays = [pa.array(key, pa.binary()), pa.array(doc, kinds), pa.array(copies, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups)), pa.array(digest, pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays([*arrays, *(_lists(x) for x in (pairs, times))], names=["key", "doc_id", "copies", *_SUMS, "pairs", "times"])

        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            for key, at, name, doc, ids in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or key != now[0]:
                    if now is not None:
                        close()
                    machine, now = Machine(names, width), (key, doc)
                if at == -1:
                    machine.copies += 1
                elif at == -2:
                    machine.whole = False
                elif machine.whole:
                    s = 0 if name == "a" else 1
                    machine.add(s, at, np.frombuffer(unpack.decompress(ids), sides[name].kind).astype(np.int64), sides[name].sizes)
                    if len(machine.ids[0]) + len(machine.ids[1]) > 4 * BLOCK:
                        out.append((*now, machine.copies, None, None, None, None, *machine.sweep()))
                if len(out) >= 200:
                    yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    return ordered.mapInArrow(stream, f"key binary, doc_id {number}, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>")


def _lists(values) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(np.asarray(v, np.int64) for v in values)])))


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``a`` is a byte-level BPE file, ``b`` a SentencePiece file, that every executor can read
    (default: the installed public ones). Null and empty texts, and texts that either
    tokenizer changes, have zeros and an empty groups_sha256. Rows are kept as they come,
    repeated and null doc_ids included; every copy counts. Ties for a B id's best pair all count.
    Other columns are dropped.
    """
    swept = staged(aligned(docs, a, b), "swept", "zstd")
    width = len(side(*_paths(a, b)["b"]).tokens)
    links = swept.select("key", "copies", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", "copies", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("n"))
    counts = staged(counts.withColumn("id", F.expr(f"pair % {width}")), "counts")
    best = counts.groupBy("id").agg(F.max("n").alias("most"))
    # The number of pairs is bounded by the vocabularies (see above), so this side can be sent to every task.
    scored = F.broadcast(counts.join(best, "id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    sums = links.join(scored, "pair").groupBy("key").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = swept.where("n_a IS NOT NULL").select("key", "doc_id", "copies", *_SUMS).join(sums, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = out.select("doc_id", "copies", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
