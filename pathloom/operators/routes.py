"""Route candidates: measures, ranking, families, overlap, selection."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def measured(steps: DataFrame) -> DataFrame:
    """Measures of each run from steps (scenario, run, pos, item, length): a repeated item is overlap."""
    first = F.row_number().over(W.partitionBy("run", "item").orderBy("pos")) == 1
    return steps.withColumn("_new", first).groupBy("scenario", "run").agg(
        F.count("*").alias("n_steps"), F.sum("length").alias("total"),
        F.sum(F.when(F.col("_new"), F.col("length")).otherwise(0)).alias("distinct_length"),
        F.sum(F.when(F.col("_new"), 0).otherwise(F.col("length"))).alias("overlap"),
        F.sum(F.when(F.col("_new"), 0).otherwise(1)).alias("repeats"),
    )


def ranked(runs: DataFrame, top: int) -> DataFrame:
    """The best ``top`` runs of each scenario: complete, more distinct length, less overlap, higher score, fewer steps; then by run.

    With a column ``signature`` (what a run visits, in order), only the best run of each signature counts.
    """
    order = [F.desc("complete"), F.desc("distinct_length"), F.asc("overlap"), F.desc("score"), F.asc("n_steps"), F.asc("run")]
    if "signature" in runs.columns:
        runs = runs.withColumn("_k", F.row_number().over(W.partitionBy("scenario", "signature").orderBy(*order))).where("_k = 1").drop("_k")
    return runs.withColumn("rank", F.row_number().over(W.partitionBy("scenario").orderBy(*order))).where(F.col("rank") <= top)


def representatives(runs: DataFrame) -> DataFrame:
    """The best run of each (scenario, family) by quality, ties to the lower run."""
    return runs.groupBy("scenario", "family").agg(F.min(F.struct((-F.col("quality")).alias("q"), "run")).alias("m"), F.count("*").alias("members")).select("scenario", "family", "m.run", (-F.col("m.q")).alias("quality"), "members")


def _by_item(items: DataFrame, tasks: int | None) -> DataFrame:
    return items.repartition(tasks, "scenario", "item") if tasks else items


def overlaps(steps: DataFrame, tasks: int | None = None) -> DataFrame:
    """(scenario, a, b, jaccard) of runs of a scenario that share an item; pairs that share none have 0 and no row. Runs meet in ``tasks`` tasks, if given."""
    items = steps.select("scenario", "run", "item").distinct()
    sizes = items.groupBy("run").agg(F.count("*").alias("n"))
    x, y = _by_item(items, tasks).alias("x"), _by_item(items, tasks).alias("y")
    shared = x.join(y, (F.col("x.scenario") == F.col("y.scenario")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.run") < F.col("y.run"))).groupBy(F.col("x.scenario").alias("scenario"), F.col("x.run").alias("a"), F.col("y.run").alias("b")).agg(F.count("*").alias("both"))
    return shared.join(sizes.select(F.col("run").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b").select("scenario", "a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def diverse(runs: DataFrame, per_scenario: int, window: int | None = 36) -> DataFrame:
    """Greedy choice of runs (scenario, run, quality, distinct_length, overlap, total, items): the best, then those far from the ones chosen before.

    ``window`` keeps the choice to the best so many runs of a scenario (or ``per_scenario``, if more); with None all of them take part. Each choice is a
    window over the scenario, so its runs need not fit in memory, and all share one shuffle. A null counts as no number, and comes last.
    """
    by = W.partitionBy("scenario")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    told = runs.select("scenario", "run", *map(number, ("quality", "distinct_length", "overlap", "total")), F.coalesce("items", F.array().cast(dict(runs.dtypes)["items"])).alias("items"))
    told = told.withColumn("_r", F.row_number().over(by.orderBy(F.desc_nulls_last("quality"), "run")))
    if window is not None:
        told = told.where(F.col("_r") <= max(window, per_scenario))
    most = lambda c: F.max(c).over(by).alias(f"_{c}")
    ratio = lambda share, c, of: F.lit(share) * F.col(c) / of
    told = told.select("*", most("quality"), most("distinct_length"))
    told = told.withColumns({f"_p{k}": ratio(share, c, F.when(F.col(f"_{c}") == 0, 1.0).otherwise(F.col(f"_{c}"))) for k, (share, c) in enumerate(((1.2, "quality"), (0.6, "distinct_length")))})
    told = told.withColumns({"_p2": ratio(0.8, "overlap", F.when(F.col("total") > 1.0, F.col("total")).otherwise(1.0)), "_far": F.lit(1.0), "_chosen": F.col("_r") == 1}).drop("_quality", "_distinct_length")
    told = told.withColumn("_last", F.max(F.when(F.col("_chosen"), F.struct("_r", "items"))).over(by))
    for _ in range(1, per_scenario):
        either = F.size(F.array_union("items", F.col("_last.items")))
        like = F.when(either > 0, F.size(F.array_intersect("items", F.col("_last.items"))) / either).otherwise(1.0)
        told = told.withColumn("_far", F.least("_far", 1 - like))
        score = 2.4 * F.col("_far") + F.col("_p0") + F.col("_p1") - F.col("_p2")
        told = told.withColumn("_next", F.when(~F.col("_chosen"), F.struct(score.alias("score"), (-F.col("_r")).alias("back"), "items")))
        told = told.withColumn("_best", F.max("_next").over(by))
        told = told.withColumns({"_chosen": F.col("_chosen") | F.coalesce(-F.col("_r") == F.col("_best.back"), F.lit(False)), "_last": F.struct(F.col("_best.back").alias("_r"), F.col("_best.items").alias("items"))})
    place = F.row_number().over(by.orderBy("_r")).cast("long").alias("place")
    return told.where("_chosen").select("scenario", "run", "quality", place)


#: So many walks, of some kB at most, are sent to every task.
FEW = 2000


def planned(runs: DataFrame, arcs: DataFrame, max_steps: int = 64, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """Seeded walks with little overlap, one row (run, pos, node) for each step.

    ``runs`` (run, seed, start, goal) and undirected ``arcs`` (a, b, length; each edge once) stay rows. Each round
    joins the walks that go on with the arcs at their node. Of the four longest that a walk has not used (ties to
    the lower node), a hash of seed, step and node draws one, with weights 4, 3, 2, 1.

    A walk has used fewer edges than it may take steps, so a node's first ``max_steps`` + 3 arcs hold its four; they are listed once
    for each node, and up to FEW walks are sent to the lists, which stay where they are.
    """
    ways = arcs.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to"), "length"), F.struct(F.col("b").alias("at"), F.col("a").alias("to"), "length"))).alias("w")).select("w.*")
    first = ways.withColumn("_k", F.row_number().over(W.partitionBy("at").orderBy(F.desc("length"), "to"))).where(F.col("_k") <= max_steps + 3)
    lists = checkpoint(first.groupBy("at").agg(F.collect_list(F.struct("to", "length")).alias("next")))
    walks = checkpoint(runs.select("run", "seed", "goal", F.col("start").alias("at"), F.array("start").alias("path"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("used")))
    left, done = walks.count(), None
    edge = F.struct(F.least("at", "to").alias("a"), F.greatest("at", "to").alias("b"))
    place = F.row_number().over(W.partitionBy("run").orderBy(F.desc("length"), "to"))
    for k in range(1, max_steps + 1):
        stopped = (F.col("at") == F.col("goal")) & F.lit(k > 1)
        going = walks.where(~stopped)
        met = lists.join(F.broadcast(going) if left <= FEW else going, "at").select(*going.columns, F.explode("next").alias("n")).select(*going.columns, "n.*")
        few = met.where(~F.array_contains("used", edge)).select("run", "seed", "at", "to", place.alias("place")).where("place <= 4")
        # The greatest u ** (1 / weight) of uniform u falls on each with its share of the weights.
        uniform = (F.pmod(F.xxhash64("seed", F.lit(k), "to"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = few.groupBy("run").agg(F.max_by("to", F.struct(F.log(uniform) / (5 - F.col("place")), "to")).alias("to"))
        both_kinds = checkpoint(walks.join(drawn, "run", "left"))
        ended = both_kinds.where("to IS NULL").select("run", "path")
        done = ended if done is None else done.unionByName(ended)
        walks = both_kinds.where("to IS NOT NULL").select("run", "seed", "goal", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("used", F.array(edge)).alias("used"))
        left = walks.count()
        if not left:
            break
    paths = walks.select("run", "path") if done is None else done.unionByName(walks.select("run", "path"))
    return paths.select("run", F.posexplode("path").alias("pos", "node")).select("run", F.col("pos").cast("long").alias("pos"), "node")


def novelty(steps: DataFrame, history: DataFrame, tasks: int | None = None) -> DataFrame:
    """(scenario, run, novelty) of the runs of ``steps``: 1 less the greatest overlap (Jaccard) with a run of ``history`` of the same scenario.

    Both are (scenario, run, item). Runs meet through the items that they share, in ``tasks`` tasks if given; one that meets none has novelty 1.
    """
    new, old = steps.select("scenario", "run", "item").distinct(), history.select("scenario", F.col("run").alias("other"), "item").distinct()
    size = new.groupBy("scenario", "run").agg(F.count("*").alias("n"))
    before = old.groupBy("scenario", "other").agg(F.count("*").alias("m"))
    both = _by_item(new, tasks).join(_by_item(old, tasks), ["scenario", "item"]).groupBy("scenario", "run", "other").agg(F.count("*").alias("k")).join(before, ["scenario", "other"]).join(size, ["scenario", "run"])
    like = both.groupBy("scenario", "run").agg(F.max(F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("like"))
    return size.join(like, ["scenario", "run"], "left").select("scenario", "run", (1.0 - F.coalesce("like", F.lit(0.0))).alias("novelty"))


def node_list(steps: DataFrame) -> DataFrame:
    """(run, nodes) of steps (run, pos, a, b): the first step's start, then every step's end, so joints appear once."""
    s = steps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("s"))
    return s.select("run", F.concat(F.array(F.col("s")[0]["a"]), F.transform("s", lambda x: x["b"])).alias("nodes"))


def uniform(*parts) -> Column:
    """A number in (0, 1) from a digest of the parts: the same on every machine."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)


def drawn(runs: DataFrame, pool: int, n: int, seed: int) -> DataFrame:
    """(scenario, run, draw): ``n`` of the ``pool`` best runs (scenario, run, rank) of each scenario, without replacement, by weights pool, pool - 1, ... in order of rank.

    The greatest log(u) / weight of uniform u go first, which draws by weight without going through the rows in turn.
    """
    few = runs.where(F.col("rank") <= pool)
    key = F.log(uniform("scenario", "run", F.lit(seed))) / F.greatest(F.lit(1), F.lit(pool + 1) - F.col("rank"))
    place = F.row_number().over(W.partitionBy("scenario").orderBy(F.desc(key), "run"))
    return few.select("scenario", "run", place.alias("draw")).where(F.col("draw") <= n)


def reordered(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``runs`` (scenario, run, rank) with the chosen run of a scenario first and all others as they were."""
    out = runs.join(chosen.select("scenario", F.col("run").alias("_c")), "scenario", "left")
    order = [F.desc(F.coalesce(F.col("run") == F.col("_c"), F.lit(False))), "rank"]
    return out.withColumn("rank", F.row_number().over(W.partitionBy("scenario").orderBy(*order))).drop("_c")


def weighted_pick(items: DataFrame, key: str, order: str, weight: str, u: Column) -> DataFrame:
    """Of each key the first item, in order, at which the sum of weights reaches ``u`` times their total; the last if none does."""
    w = W.partitionBy(key).orderBy(order)
    sums = items.withColumns({"_sum": F.sum(weight).over(w), "_all": F.sum(weight).over(W.partitionBy(key))})
    hit = F.when(F.col("_sum") >= u * F.col("_all"), F.col(order))
    return sums.withColumn("_at", F.coalesce(F.min(hit).over(W.partitionBy(key)), F.max(order).over(W.partitionBy(key)))).where(F.col(order) == F.col("_at")).drop("_sum", "_all", "_at")


def repeated_items(steps: DataFrame) -> DataFrame:
    """(run, items): those that a run visits more than once, in the order of their second visits."""
    second = steps.withColumn("_k", F.row_number().over(W.partitionBy("run", "item").orderBy("pos"))).where("_k = 2")
    return second.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))


def visits(steps: DataFrame) -> DataFrame:
    """(run, item, visits)."""
    return steps.groupBy("run", "item").agg(F.count("*").alias("visits"))


def recent(seen: DataFrame, most: int = 12) -> DataFrame:
    """(key, signature, place) of what was seen last (key, ord, signature): each signature once, the latest first, at most ``most``."""
    last = seen.groupBy("key", "signature").agg(F.max("ord").alias("ord"))
    return last.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.desc("ord")))).where(F.col("place") <= most).select("key", "signature", "place")


def latest(results: DataFrame) -> DataFrame:
    """The results (key, request, ...) of each key's latest request; what comes late for earlier ones is dropped."""
    return results.withColumn("_m", F.max("request").over(W.partitionBy("key"))).where("request = _m").drop("_m")


def improvements(found: DataFrame, every: int) -> DataFrame:
    """(run, iteration, best) of iterations (run, iteration, score): the best so far at every ``every``-th one and the last, where it changed."""
    w = W.partitionBy("run").orderBy("iteration")
    best = found.withColumns({"best": F.max("score").over(w.rowsBetween(W.unboundedPreceding, 0)), "_last": F.max("iteration").over(W.partitionBy("run"))})
    told = best.where((F.col("iteration") % every == 0) | (F.col("iteration") == F.col("_last"))).withColumn("_before", F.lag("best").over(w))
    return told.where(~F.col("best").eqNullSafe(F.col("_before"))).select("run", "iteration", "best")


def diverse_pool(runs: DataFrame, size: int, window: int = 12) -> DataFrame:
    """(scenario, run, place): the best run (scenario, run, rank, score, items), then again and again the one least like those chosen, ties by score, then by rank.

    A scenario brings its best ``window`` runs (or ``size``, if more), so a group is bounded. Runs without items are alike.
    """

    def chosen_of(listed):
        """Of one scenario's runs (rank, run, score, items) in order."""
        sets, scores = [set(r["items"]) for r in listed], [float("nan") if r["score"] is None else r["score"] for r in listed]
        like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0
        chosen, left, far = [0], list(range(1, len(listed))), [1.0] * len(listed)
        while left and len(chosen) < size:
            for i in left:
                far[i] = min(far[i], 1 - like(i, chosen[-1]))
            best = max(left, key=lambda i: (far[i], scores[i], -i))
            chosen.append(best)
            left.remove(best)
        return [(listed[i]["run"], place) for place, i in enumerate(chosen, 1)]

    def choose(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out = [(key, *row) for key, listed in zip(some.column("scenario").to_pylist(), some.column("listed").to_pylist(), strict=True) for row in chosen_of(listed)]
                yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(3)], names=["scenario", "run", "place"])

    # Many scenarios go to Python in one batch: a call for each of them costs more than the choice.
    listed = runs.where(F.col("rank") <= max(size, window)).groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("rank", "run", "score", "items"))).alias("listed"))
    return listed.select(F.col("scenario").cast("long").alias("scenario"), "listed").mapInArrow(choose, "scenario long, run long, place long")


#: How like a driven route a new one may be, and what a route that was driven exactly so costs.
TOO_LIKE, DRIVEN = 0.94, 10.0


def history_pick(runs: DataFrame, driven: DataFrame, seed: int, pool: int = 5, window: int = 12) -> DataFrame:
    """(scenario, run, novelty, worth): of each scenario that has a history, one of its best and newest runs, drawn by a seed.

    ``runs`` is (scenario, run, rank, score, distinct_length, overlap, total, signature), ``driven`` (scenario, run, novelty, known): how new a
    run is to the history, and whether it was driven exactly so. Only the first runs of a scenario by rank take part. Those not driven
    yet and less than TOO_LIKE a driven one come first, else those not driven yet, else all. Scenarios without history are left to ``diverse_pool`` and ``drawn``.
    """
    by = W.partitionBy("scenario")
    few = runs.where(F.col("rank") <= max(3 * window, 4 * pool, 24)).join(driven, ["scenario", "run"])
    most = lambda c: F.greatest(F.max(c).over(by), F.lit(1.0))
    worth = 5.0 * F.col("novelty") + F.col("score") / most("score") + 0.35 * F.col("distinct_length") / most("distinct_length") - 0.8 * F.col("overlap") / F.greatest(F.col("total"), F.lit(1.0)) - F.when(F.col("known"), DRIVEN).otherwise(0.0) - 0.03 * (F.col("rank") - 1)
    level = F.when(~F.col("known") & (F.col("novelty") > 1 - TOO_LIKE), 0).when(~F.col("known"), 1).otherwise(2)
    told = few.withColumns({"worth": worth, "level": level}).withColumn("first", F.min("level").over(by)).where((F.col("level") == F.col("first")) | (F.col("first") == 2))
    told = told.withColumn("place", F.row_number().over(by.orderBy(F.desc("worth"), "rank"))).where(F.col("place") <= max(pool, 3)).withColumn("n", F.count("*").over(by))
    weighed = told.withColumn("weight", F.greatest(F.lit(1e-6), F.col("n") - F.col("place") + 1 + 5.0 * F.greatest(F.lit(0.0), F.col("novelty"))))
    return weighted_pick(weighed, "scenario", "place", "weight", uniform("scenario", F.lit(seed))).select("scenario", "run", "novelty", "worth")


def known(runs: DataFrame, history: DataFrame) -> DataFrame:
    """(scenario, run, known) of the runs (scenario, run, signature) of scenarios with a history (scenario, signature): whether it has the same signature."""
    same = history.select("scenario", "signature").distinct().withColumn("_k", F.lit(True))
    return runs.join(history.select("scenario").distinct(), "scenario").join(same, ["scenario", "signature"], "left").select("scenario", "run", F.coalesce("_k", F.lit(False)).alias("known"))
