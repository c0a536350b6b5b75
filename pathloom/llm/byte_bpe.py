"""Byte-level BPE by recursive DuckDB queries, one engine per Spark task.

A task splits its texts into pieces and sends the pieces that it has not met yet to
DuckDB in small lots: a recursive query joins the token positions of every piece with
the merge table and contracts each piece's leftmost pair of least rank, until no pair is
left. Decoding joins ids with the vocabulary and aggregates in the order of positions.
There is no shuffle; what a task keeps is bounded by LOT and CACHE.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Pieces in one recursive query; pieces remembered in a task; bytes from which a piece is merged with a heap instead, as each round reads the whole piece.
LOT, CACHE, LONG_PIECE = 20_000, 600_000, 400
#: Ids in one decoding query.
PART = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: A row knows the place of the token after it and that token's id, so a round needs no window: it takes each piece's least
#: (rank, place), drops the token after that place, and looks up only the two pairs that change.
_ENCODE = """
WITH RECURSIVE t(piece, pos, id, after, next, merged, round) AS (
  SELECT s.piece, s.pos, s.id, s.after, s.next, m.merged, 0 FROM start s LEFT JOIN merges m ON m.pair = s.id * 65536 + s.next
  UNION ALL
  SELECT x.piece, x.pos, x.id, x.after, x.next, CASE WHEN x.pair IS NULL THEN x.merged ELSE m.merged END, x.round + 1
  FROM (
    SELECT t.piece, t.pos, t.round, t.merged,
      CASE WHEN t.pos = b.place THEN b.best ELSE t.id END AS id,
      CASE WHEN t.pos = b.place THEN gone.after ELSE t.after END AS after,
      CASE WHEN t.pos = b.place THEN gone.next WHEN t.after = b.place THEN b.best ELSE t.next END AS next,
      CASE WHEN t.pos = b.place THEN coalesce(b.best * 65536 + gone.next, -1) WHEN t.after = b.place THEN t.id * 65536 + b.best END AS pair
    FROM t
    JOIN (
      SELECT piece, min(merged * 512 + pos) // 512 AS best, min(merged * 512 + pos) % 512 AS place, arg_min(after, merged * 512 + pos) AS partner
      FROM t WHERE merged IS NOT NULL GROUP BY piece
    ) b ON b.piece = t.piece
    JOIN t gone ON gone.piece = b.piece AND gone.pos = b.partner
    WHERE t.pos <> b.partner
  ) x LEFT JOIN merges m ON m.pair = x.pair
),
last AS (SELECT piece, max(round) AS round FROM t GROUP BY piece)
SELECT piece, list(id ORDER BY pos) AS ids FROM t JOIN last USING (piece, round) GROUP BY piece ORDER BY piece
"""

_DECODE = """
SELECT part, count(*) AS n, string_agg(hex, '' ORDER BY pos) AS decoded FROM coded JOIN vocabulary USING (id) GROUP BY part ORDER BY part
"""


class Engine:
    """The merge table and vocabulary of one rank file in an in-memory DuckDB."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("pairs of ids are packed in 32 bits: ranks must be below 65536")
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        a, b, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), merged.append(rank)
        self.merges = {(x, y): z for x, y, z in zip(a, b, merged, strict=True)}
        pairs = [x * 65536 + y for x, y in zip(a, b, strict=True)]
        self._load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self._load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.single = [self.ranks[bytes([k])] for k in range(256)]
        self.known: dict[str, bytes] = {}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def _recursive(self, pieces: list[bytes]) -> list[list[int]]:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        pos = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
        ids = np.array(self.single, np.int64)[raw]
        final = np.zeros(len(raw), bool)
        final[ends - 1] = True
        self._load("start", pa.table({
            "piece": np.repeat(np.arange(len(pieces)), sizes), "pos": pos, "id": ids,
            "after": pa.array(pos + 1, mask=final), "next": pa.array(np.append(ids[1:], 0), mask=final)}))
        return self.db.sql(_ENCODE).to_arrow_table().column("ids").to_pylist()

    def _heap(self, piece: bytes) -> list[int]:
        """The same contraction for one long piece, in n log n."""
        ids = [self.single[x] for x in piece]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        alive = [True] * len(ids)
        queue = [(m, k) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            m, k = heapq.heappop(queue)
            j = after[k] if alive[k] else -1
            if j < 0 or self.merges.get((ids[k], ids[j])) != m:
                continue
            ids[k], alive[j], after[k] = m, False, after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (x := self.merges.get((m, ids[after[k]]))) is not None:
                    heapq.heappush(queue, (x, k))
            if before[k] >= 0 and (x := self.merges.get((ids[before[k]], m))) is not None:
                heapq.heappush(queue, (x, before[k]))
        return [x for x, here in zip(ids, alive, strict=True) if here]

    def learn(self, pieces: set[str]) -> None:
        """Make the codes of ``pieces`` known."""
        pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
        lot: list[tuple[str, bytes]] = []
        for piece in sorted(pieces):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.known[piece] = pack(self._heap(raw))
            else:
                lot.append((piece, raw))
        for k in range(0, len(lot), LOT):
            some = lot[k : k + LOT]
            for (piece, _), ids in zip(some, self._recursive([raw for _, raw in some]), strict=True):
                self.known[piece] = pack(ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, in order: its ids as little-endian 32-bit integers."""
        split = self.pattern.findall
        start, size = 0, 0
        for end in range(1, len(texts) + 1):
            size += len(texts[end - 1])
            if size < 1 << 20 and end < len(texts):
                continue
            pieces = [split(t) for t in texts[start:end]]
            new = set().union(*pieces).difference(self.known)
            if len(self.known) + len(new) > CACHE:
                self.known = {p: self.known[p] for p in set().union(*pieces) if p in self.known}  # what is in use stays
            self.learn(new)
            known = self.known
            yield from (b"".join([known[p] for p in each]) for each in pieces)
            start, size = end, 0

    def decode(self, coded: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids. A query takes PART ids at most, so a long list is decoded in parts; an unknown id is an error."""
        out = [[] for _ in coded]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids, doc = np.concatenate([np.zeros(0, np.int32), *coded]), np.repeat(np.arange(len(coded)), sizes)
        for k in range(0, len(ids), PART):
            some, of = ids[k : k + PART], doc[k : k + PART]
            self._load("coded", pa.table({"part": of, "pos": np.arange(len(some), dtype=np.int32), "id": some.astype(np.int32)}))
            found = self.db.execute(_DECODE).fetchall()
            if sum(n for _, n, _ in found) != len(some):
                raise ValueError("an id is not in the vocabulary")
            for part, _, x in found:
                out[part].append(bytes.fromhex(x))
        return [b"".join(x) for x in out]


@lru_cache(maxsize=1)
def engine(path: str, pattern: str) -> Engine:
    """Once for each Python worker; the tasks after reuse it."""
    return Engine(path, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row's text, or with ``digests`` n_tokens, ids_sha256 and decoded_sha256.

    Null texts are empty and have no ids. Special tokens' strings are ordinary text. Rows keep
    their place: repeated and null doc_ids are coded like any others; other columns are dropped.
    ``path`` is a rank file that every executor can read (default: the installed public one).
    """
    path, pattern = _vocabulary(path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = [t or "" for t in some.column("text").to_pylist()]
                if digests:
                    ids = list(bpe.encode(texts))
                    digest = lambda found: pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string())
                    columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(bpe.decode([np.frombuffer(x, np.int32) for x in ids]))]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns, names = [pa.array([np.frombuffer(ids, np.int32) for ids in bpe.encode(texts)], pa.list_(pa.int32()))], ["ids"]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(code, f"doc_id {kind}, {out}")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes (binary) of rows (doc_id, ids). Null or empty ids give no bytes."""
    path, pattern = _vocabulary(path, None)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(bpe.decode([np.array(x or [], np.int32) for x in some.column("ids").to_pylist()]), pa.binary())], names=["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(back, f"doc_id {kind}, bytes binary")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
