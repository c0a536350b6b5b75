"""Quality by hierarchical empirical Bayes: a document's own evidence, and what is known of its path and host.

Documents give log odds from hashed features, with weights from at most SAMPLE labelled
texts. Sites give posterior rates: a path's rate shrinks toward its host's, a host's toward
the global one, by a strength that the spread between sites tells. Both meet as log odds.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npbytes as nb
from .common import staged, table

#: Labelled texts that weights are fitted on, chosen by a hash of doc_id; hashed features; least z-score and largest number of those that get a weight; steps and L2 penalty of the fit.
SAMPLE, FEATURES, MIN_Z, CHOSEN, STEPS, PENALTY = 20_000, 1 << 18, 4.0, 2000, 300, 1e-4
TARGETS = ("quality", "toxic")
_CHUNK = 1 << 20
_PREFIXES = (5, 6, 7, 8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])


def features(column) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text: words, their beginnings and last bytes, and shape classes."""
    data, offsets = nb.buffers(column)
    for i, j in nb.groups(offsets, _CHUNK):
        raw, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        low = nb.lower_az(raw)
        starts, ends, first = nb.words(low, off, nb.ALNUM)
        h = nb.word_hashes(low, starts, ends)
        parts = [h]
        for k in _PREFIXES:
            cut = nb.word_hashes(low, starts, np.minimum(ends, starts + k)) + np.uint64(k)
            parts.append(np.where(ends - starts > k, nb.mix(cut), h))
        tokens, stops, head = nb.words(raw, off)
        last = raw[stops - 1].astype(np.uint64) * np.uint64(256) + raw[np.maximum(stops - 2, tokens)]
        odd = ~nb.ALNUM[raw[stops - 1]] & ~nb.byte_class(b".,")[raw[stops - 1]]
        loud = _UPPER[raw[tokens]] & _UPPER[raw[np.minimum(tokens + 1, stops - 1)]]
        tails = nb.mix(last + np.uint64(1 << 40))
        for k in range(j - i):
            a, b, c, d = int(first[k]), int(first[k + 1]), int(head[k]), int(head[k + 1])
            n = max(1, d - c)
            shape = (min(9, int(10 * odd[c:d].sum() / n)), min(9, int(10 * loud[c:d].sum() / n)), min(9, int(10 * len(np.unique(h[a:b])) / max(1, b - a))) * 8 + min(7, int(n).bit_length() // 2), min(9, len(raw[off[k] : off[k + 1]]) // n))
            own = np.array([(f + 1) * 1000 + v for f, v in enumerate(shape)], np.uint64)
            yield np.unique(np.concatenate([*(p[a:b] for p in parts), tails[c:d], nb.mix(own)]) % np.uint64(FEATURES)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, class, texts): class is quality + 2 * toxic; feature -1 counts the texts."""
    counts = np.zeros((FEATURES + 1, 4), np.int64)
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        for kind, found in zip(kinds, features(batch.column("text")), strict=True):
            counts[found, kind] += 1
            counts[FEATURES, kind] += 1
    for kind in range(4):
        at = np.flatnonzero(counts[:, kind])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), kind)), pa.array(counts[at, kind])], names=["feature", "kind", "texts"])


def _logistic(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Log odds that each of ``width`` features adds, beyond the overall rate: L2-penalised logistic regression."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    base = np.log(y.mean() / (1 - y.mean()))
    w, shift, m, v = np.zeros(width), 0.0, np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, w[at], len(rows)) + base + shift
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        slope = np.append(np.bincount(at, error[owner], width) + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, shift = w - move[:-1], shift - move[-1]
    return np.append(w, shift)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (FEATURES + 1, 2): log odds that a feature's presence adds for quality and for toxic, and a constant.

    At most ``sample`` labelled texts are read: first to pick the CHOSEN features whose rates
    differ most between the classes, by a z-score of MIN_Z at least, then to fit those.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("kind"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "kind").limit(sample)
    texts = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "kind"), "sample")  # bounded by ``sample`` rows of two numbers
    rows = texts.mapInArrow(_counts, "feature long, kind long, texts long").groupBy("feature", "kind").agg(F.sum("texts").alias("texts")).toPandas()
    counts = np.zeros((FEATURES + 1, 4))
    counts[rows.feature.to_numpy(int), rows.kind.to_numpy(int)] = rows.texts
    weights = np.zeros((FEATURES + 1, 2), np.float32)
    picks: list[np.ndarray] = []
    for yes, no in (((1, 3), (0, 2)), ((2, 3), (0, 1))):
        with_yes, with_no = counts[:, yes].sum(1), counts[:, no].sum(1)
        all_yes, all_no = with_yes[-1], with_no[-1]
        if not all_yes or not all_no:
            picks.append(np.zeros(0, np.int64))
            continue
        x, y = with_yes[:-1], with_no[:-1]
        rate = (x + y) / (all_yes + all_no)
        # Rates that differ by chance count nothing.
        z = np.abs(x / all_yes - y / all_no) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / all_yes + 1 / all_no))
        best = np.argsort(-z, kind="stable")[:CHOSEN]
        picks.append(np.sort(best[z[best] >= MIN_Z]))
    union = np.unique(np.concatenate(picks))

    def chosen_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(union, f[np.isin(f, union)]).astype(np.uint16).tobytes() for f in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(found, pa.binary())], names=["kind", "found"])

    # At most ``sample`` strings of two bytes for each of the 2 * CHOSEN features that a text has.
    rows = texts.mapInArrow(chosen_of, "kind int, found binary").toPandas()
    for t, pick in enumerate(picks):
        if not len(pick):
            continue
        own = np.full(len(union), -1)
        own[np.searchsorted(union, pick)] = np.arange(len(pick))
        kept = [f[f >= 0] for f in (own[np.frombuffer(r, np.uint16)] for r in rows.found)]
        fitted = _logistic(kept, ((rows.kind.to_numpy(int) >> t) & 1).astype(float), len(pick))
        weights[pick, t], weights[FEATURES, t] = fitted[:-1], fitted[-1]
    return weights


def evidence(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with quality_odds and toxic_odds; the weights have a fixed size (2 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            odds = np.array([w[f].sum(axis=0) + w[-1] for f in features(batch.column("text"))], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(odds[:, 0]), pa.array(odds[:, 1])], names=[*keep, "quality_odds", "toxic_odds"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(score, f"{kinds}, quality_odds double, toxic_odds double")


def _strength(groups: DataFrame, n: str, k: str, rate) -> float:
    """How many labels the prior counts as, by the method of moments: little spread between sites means strong shrinking."""
    spread = groups.agg(F.sum(F.col(n)), F.sum(F.col(n) * (F.col(k) / F.col(n) - rate) ** 2), F.sum(F.col(n) * F.col(n)), F.count("*"), F.sum(F.col(n) * rate * (1 - rate))).first()
    total, between, squares, sites, within = (float(x or 0) for x in spread)
    if sites < 2 or total == 0 or within == 0:
        return 100.0
    inner = within / total
    free = max(total - squares / total, 1e-9)
    variance = max((between - (sites - 1) * inner) / free, inner * 1e-3)
    return min(1000.0, max(1.0, inner / variance - 1))


def site_rates(sites: DataFrame, target: str) -> DataFrame:
    """(host, path, rate): posterior rates of ``target`` from rows (host, path, n_<target>, k_<target>); n of 0 gives the host's rate."""
    k, n = f"k_{target}", f"n_{target}"
    overall = sites.agg(F.sum(k), F.sum(n)).first()
    base = (float(overall[0] or 0) + 0.5) / (float(overall[1] or 0) + 1.0)
    hosts = sites.groupBy("host").agg(F.sum(n).alias("hn"), F.sum(k).alias("hk"))
    m = _strength(hosts.where("hn > 0"), "hn", "hk", F.lit(base))
    hosts = hosts.select("host", ((F.col("hk") + m * base) / (F.col("hn") + m)).alias("host_rate"))
    paths = sites.join(hosts, "host")
    m = _strength(paths.where(F.col(n) > 0), n, k, F.col("host_rate"))
    return paths.select("host", "path", ((F.col(k) + F.lit(m) * F.col("host_rate")) / (F.col(n) + m)).alias(f"{target}_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality_odds, toxic_odds (own evidence), quality, toxic (posterior probabilities) and kept of every row.

    kept: quality of one half or more and toxic under it. Null texts have only the features of
    an empty one; null hosts and paths are sites named by the empty string. Repeated labels
    count each time; a label that is null or not 0 or 1 counts for nothing, while the row's other label does. Without labels all odds are 0 and rates one half, so all is
    kept. Rows that repeat a doc_id are judged by their own texts. Other columns are dropped.
    """
    weights = fit(docs, labels, sample)
    site = [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")]
    scored = staged(evidence(docs.select("doc_id", "text", *site), weights, ["doc_id", "host", "path"]), "evidence")
    marks = labels.select("doc_id", *(F.when(F.col(t).isin(0, 1), F.col(t)).alias(t) for t in TARGETS))
    sites = scored.join(marks, "doc_id", "left").groupBy("host", "path").agg(*(F.count(t).alias(f"n_{t}") for t in TARGETS), *(F.coalesce(F.sum(t), F.lit(0)).alias(f"k_{t}") for t in TARGETS))
    sites = staged(sites, "sites")
    rates = site_rates(sites, "quality").join(site_rates(sites, "toxic"), ["host", "path"])
    out = scored.join(staged(rates, "rates"), ["host", "path"])
    for t in TARGETS:
        out = out.withColumn(t, 1 / (1 + F.exp(-F.greatest(F.least(F.col(f"{t}_odds") + F.log(F.col(f"{t}_rate") / (1 - F.col(f"{t}_rate"))), F.lit(50.0)), F.lit(-50.0)))))
    return out.select("doc_id", "quality_odds", "toxic_odds", "quality", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
