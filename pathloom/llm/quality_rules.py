"""Quality rules as a learned decision list. DataFrame operations only.

Features of every text are Spark expressions. The labelled rows are reduced to a
histogram over quantile cells (at most (BINS + 10) ** features rows, whatever the input),
and sequential covering grows and prunes conjunctions of thresholds on it. The
result is an ordered Spark CASE expression.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, aside, row_key, staged, table, text_or_empty

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Fixed values of the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Quantile bins of a feature, most rules, most conditions of a rule, least labelled rows and least precision of a rule.
BINS, MAX_RULES, MAX_CONDITIONS, MIN_SUPPORT, MIN_PRECISION = 8, 6, 3, 5, 0.75
#: What the rules may test: shares, so that long and short texts compare.
RULE_FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "word_length")


def _shifted_pairs(h: str, by: int) -> Column:
    """Hashes of h[i] with h[i + by], for each i that has both."""
    n = F.size(h) - by
    return F.when(n > 0, F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(h, by + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) added.

    Null and empty texts have zeros. A text of fewer than 8 words has no window. Work on a
    text grows as n log n with its words: windows are hashes in an array, repeats are found
    by sorting it, and only where the distinct count shows that there are any. Columns of
    the added names are replaced, all others stay as they are.
    """
    t, own = text_or_empty(text), "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    x = lambda name: f"{own}{name}"
    out = docs.withColumn(x("w"), F.filter(F.split(t, WORD_GAP, -1), lambda w: w != ""))
    out = out.withColumn(x("h1"), F.transform(x("w"), lambda w: F.xxhash64(w)))
    for size in (1, 2, 4):
        out = out.withColumn(x(f"h{2 * size}"), _shifted_pairs(x(f"h{size}"), size))
    repeats = F.col(x("repeats"))
    out = out.withColumn(x("repeats"), F.size(x("h8")) > F.size(F.array_distinct(x("h8"))))
    # (hash, place) in order; a place whose neighbour has the same hash starts a repeated window.
    out = out.withColumn(x("s"), F.when(repeats, F.array_sort(F.transform(x("h8"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size(x("s"))
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    out = out.withColumn(x("z"), F.when(repeats, F.arrays_zip(
        F.col(x("s")).alias("x"), F.concat(nothing, F.slice(x("s"), 1, n - 1)).alias("p"), F.concat(F.slice(x("s"), 2, n), nothing).alias("q"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    out = out.withColumn(x("i"), F.array_sort(F.transform(F.filter(x("z"), lambda z: same(z["x"], z["p"]) | same(z["x"], z["q"])), lambda z: z["x"]["i"])))
    # Words in the union of [i, i + 8): each window adds what lies before the next one starts.
    folded = F.aggregate(
        F.col(x("i")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n", -1), lambda v: F.length(F.translate(v, SPACES, "")) > 0)
    out = out.withColumn(x("l"), lines)
    return out.withColumns({
        "n_words": F.size(x("w")).cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(x("l")) - F.size(F.array_distinct(x("l")))).cast("long"),
        "n_repeat_words": F.when(repeats, folded).otherwise(F.lit(0)).cast("long"),
    }).drop(*map(x, ("w", "h1", "h2", "h4", "h8", "repeats", "s", "z", "i", "l")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def rule_features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / n,
        "word_length": F.col("word_chars") / n,
    }


@dataclass(frozen=True)
class Rule:
    """All of ``conditions`` (feature, threshold, above): value > threshold, or value <= threshold."""

    conditions: tuple[tuple[str, float, bool], ...]

    def column(self) -> Column:
        tests = [F.col(f) > F.lit(t) if above else F.col(f) <= F.lit(t) for f, t, above in self.conditions]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, else the text is kept."""

    rules: tuple[Rule, ...]

    def rejects(self) -> Column:
        if not self.rules:
            return F.lit(False)
        out = F.when(F.coalesce(self.rules[0].column(), F.lit(False)), True)
        for rule in self.rules[1:]:
            out = out.when(F.coalesce(rule.column(), F.lit(False)), True)
        return out.otherwise(False)


def _histogram(labelled: DataFrame, bins: int) -> tuple[dict[str, list[float]], list[tuple[tuple[int, ...], int, int, int]]]:
    """Thresholds of each feature; and rows (cell, part, good, bad). Both are bounded by ``bins`` and the features."""
    at = [k / bins for k in range(1, bins)]
    # Quantiles of each class too: where bad texts are rare, the overall ones may not separate them.
    # Exact ones of values of three decimals, so that no order of rows changes a rule; an aggregate holds the distinct values.
    near = lambda f: F.round(f, 3)
    picks = labelled.agg(*[F.percentile(near(f), at).alias(f) for f in RULE_FEATURES], *[F.percentile(F.when(F.col("label") == k, near(f)), [0.02, 0.1, 0.5, 0.9, 0.98]).alias(f"{f}_{k}") for f in RULE_FEATURES for k in (0, 1)]).first()
    edges = {f: sorted({float(x) for name in (f, f"{f}_0", f"{f}_1") for x in (picks[name] or [])}) for f in RULE_FEATURES}
    cells = [reduce(lambda a, b: a + b, [(F.col(f) > F.lit(e)).cast("int") for e in edges[f]], F.lit(0)).alias(f"b{i}") for i, f in enumerate(RULE_FEATURES)]
    rows = labelled.select(*cells, "part", "label").groupBy(*[f"b{i}" for i in range(len(cells))], "part").agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1))).collect()
    return edges, [(tuple(r[: len(cells)]), r[len(cells)], r[-2], r[-1]) for r in rows]


def _covers(conditions, cell) -> bool:
    return all((cell[f] > e) == above for f, e, above in conditions)


def learn(labelled: DataFrame, bins: int = BINS) -> DecisionList:
    """Sequential covering over rows (label 0/1, part: 0 prunes, others grow, and RULE_FEATURES).

    Grows: adds the condition with the best FOIL gain until the rule covers no kept text of
    the grow part or is full. Prunes: drops final conditions while precision on the prune
    part does not fall. Stops at MAX_RULES, or at a rule under MIN_SUPPORT or MIN_PRECISION.
    No labels, or one class only: no rules, all texts are kept. Null labels are ignored.
    """
    from math import log2

    edges, rows = _histogram(labelled.where(F.col("label").isNotNull()), bins)
    rules: list[Rule] = []

    def counts(conditions, grow: bool) -> tuple[int, int]:
        good = bad = 0
        for cell, part, g, b in rows:
            if (part != 0) == grow and _covers(conditions, cell):
                good, bad = good + g, bad + b
        return good, bad

    options = [(i, e, above) for i, f in enumerate(RULE_FEATURES) for e in range(len(edges[f])) for above in (True, False)]
    while len(rules) < MAX_RULES:
        conditions: tuple = ()
        good, bad = counts(conditions, True)
        while bad and good and len(conditions) < MAX_CONDITIONS:
            before, best, gain = log2(bad / (good + bad)), None, 1e-9
            for option in options:
                g, b = counts((*conditions, option), True)
                if b >= MIN_SUPPORT and (x := b * (log2(b / (g + b)) - before)) > gain:
                    best, gain = option, x
            if best is None:
                break
            conditions = (*conditions, best)
            good, bad = counts(conditions, True)
        share = lambda c: (lambda g, b: (b + 1) / (g + b + 2))(*counts(c, False))
        while len(conditions) > 1 and share(conditions[:-1]) >= share(conditions):
            conditions = conditions[:-1]
        g, b = (x + y for x, y in zip(counts(conditions, True), counts(conditions, False), strict=True))
        if not conditions or b < MIN_SUPPORT or b / (g + b) < MIN_PRECISION:
            break
        rules.append(Rule(tuple((RULE_FEATURES[f], edges[RULE_FEATURES[f]][e], above) for f, e, above in conditions)))
        rows = [r for r in rows if not _covers(conditions, r[0])]
    return DecisionList(tuple(rules))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, rid (the row key), the text features, base_failed and kept of every row of ``docs``.

    ``labels`` (doc_id, quality 0/1) may cover any part of them; repeated labels count each
    time. Rows with null doc_id are judged like the others and never labelled.
    """
    narrow = staged(text_features(docs.select("doc_id", "text", row_key().alias("rid"))).drop("text").withColumn("base_failed", base_failed()), "features")
    shares = narrow.withColumns(rule_features())
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    labelled = shares.where(~F.col("base_failed")).join(marks, "doc_id").select("label", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"), *RULE_FEATURES)
    rules = learn(labelled)
    return shares.withColumn("kept", ~F.col("base_failed") & ~rules.rejects()).drop(*RULE_FEATURES)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are. Verdicts depend on the text and go by doc_id and text together."""
    docs, back = aside(docs, "doc_id", "text")
    kept = judged(docs, labels).where("kept").select(F.col("rid").alias("_rid")).distinct()
    return back(docs.withColumn("_rid", row_key()).join(kept, "_rid", "left_semi"))
