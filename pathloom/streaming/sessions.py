"""What a planning session shows, as keyed state of a stream: progress, stale results, and the routes seen last.

Messages come in any order and may come twice. What a batch makes of the state does not depend on the order in it: the latest
request with its best score, and the latest place of each of the signatures seen last. Memory for a key is bounded,
whatever its share of the messages.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.inputs import shared_folder

#: Routes that a key's history keeps.
RECENT = 12
OUT = "key string, told long, request long, iteration long, best double, stale long, signatures array<string>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Session(StatefulProcessor):
    """Of each key: the best of its latest request, how many results came too late for theirs, and the last RECENT signatures, the latest first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._active = handle.getValueState("active", "told long, request long, iteration long, best double, stale long")
        self._seen = handle.getValueState("seen", "ord array<long>, signatures array<string>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator[Row]:
        before = tuple(self._active.get()) if self._active.exists() else (0, None, None, None, 0)
        told, request, iteration, best, stale = before
        last = dict(zip(*reversed(tuple(self._seen.get())))) if self._seen.exists() else {}
        recent = sorted(last, key=last.get, reverse=True)
        latest = request
        for r in rows:
            if latest is not None and r.request < latest:
                stale += 1
                continue
            if request is None or r.request > request:
                request, iteration, best = r.request, None, None
            if r.request == request and r.score is not None and (best is None or (r.score, -r.iteration) > (best, -iteration)):
                iteration, best = r.iteration, r.score
            if r.signature is not None:
                last[r.signature] = max(r.ord, last.get(r.signature, r.ord))
                if len(last) >= 4 * RECENT:
                    last = self._latest(last)
        last = self._latest(last)
        now = sorted(last, key=last.get, reverse=True)
        news = (request, iteration, best) != before[1:4] or now != recent
        self._active.update((told + news, request, iteration, best, stale))
        self._seen.update(([last[s] for s in now], now))
        if news:
            yield Row(key=str(key[0]), told=told + 1, request=request, iteration=iteration, best=best, stale=stale, signatures=now)

    @staticmethod
    def _latest(last: dict[str, int]) -> dict[str, int]:
        return {s: last[s] for s in sorted(last, key=lambda s: (-last[s], s))[:RECENT]}

    def close(self) -> None:
        pass


def sessions(messages: DataFrame) -> DataFrame:
    """(key, told, request, iteration, best, stale, signatures): a row for each batch that changes what a key shows.

    ``messages`` is a stream of (key, request, iteration, score, signature, ord). Results of a request older than the latest one of
    the batches before are stale: counted, and without effect. Among equal scores the earliest iteration stands. A null signature is no route, and a
    null score no result. ``told`` numbers the rows of a key from 1.
    """
    return messages.select("key", "request", "iteration", "score", "signature", "ord").groupBy("key").transformWithState(Session(), OUT, "update", "none")


def drained(messages: DataFrame, where: str) -> DataFrame:
    """What each key shows in the end, once all that is there of ``messages`` has been read. ``where`` keeps the state and what was told: a second call goes on from there."""
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/told/batch={batch}")

    running = sessions(messages).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    told = spark.read.schema(OUT).parquet(f"{where}/told")
    return told.groupBy("key").agg(F.max_by(F.struct(*[c for c in told.columns if c not in ("key", "batch")]), "told").alias("x")).select("key", "x.*")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of all users of the events table: a request a day, a result an event."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    messages = events.select(
        F.col("user_id").cast("string").alias("key"), F.unix_date(F.to_date("ts")).cast("long").alias("request"), F.col("event_id").cast("long").alias("iteration"), F.col("value").cast("double").alias("score"),
        F.concat_ws("-", "event_type", F.pmod(F.col("event_id"), F.lit(7))).alias("signature"), F.col("event_id").cast("long").alias("ord"))
    return drained(messages, f"{shared_folder(spark)}/sessions_{uuid.uuid4().hex}")
