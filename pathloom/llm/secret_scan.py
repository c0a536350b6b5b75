"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control. DataFrame operations only.

A candidate is a run of 16 or more letters, digits, ``+ / _ -``. The smallest alphabet that
holds it is its encoding. Three tests ask whether it could be a uniform draw from that
alphabet: chi-squared of the letter counts, the number of runs of its upper and lower half,
and the correlation of neighbours. What passes all three is held against ordinary text: the
chance that text of that length, whose letters coincide as often as those of a language do,
would look as even. That chance falls with the length, and the candidates of each encoding
and length band are cut where the expected share of false ones is LEVEL (Benjamini and
Hochberg, over bins of the chance, so that only counts of bins are brought together).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

#: The base kinds in their order: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*BASE, "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, the smallest first: name, what it looks like, its alphabet in order. Digits alone are numbers and are not tested.
ENCODINGS = [
    ("hex", "[0-9a-f]*[a-f][0-9a-f]*", _DIGITS + "abcdef"), ("HEX", "[0-9A-F]*[A-F][0-9A-F]*", _DIGITS + "ABCDEF"), ("base32", "[A-Z2-7]*[A-Z][A-Z2-7]*", _UPPER + "234567"),
    ("base36", "[0-9a-z]*[a-z][0-9a-z]*", _DIGITS + _LOWER), ("BASE36", "[0-9A-Z]*[A-Z][0-9A-Z]*", _DIGITS + _UPPER), ("base62", "[0-9A-Za-z]*[A-Za-z][0-9A-Za-z]*", _DIGITS + _UPPER + _LOWER),
    ("base64", "[0-9A-Za-z+/]*[A-Za-z+/][0-9A-Za-z+/]*", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", "[0-9A-Za-z_-]*[A-Za-z_-][0-9A-Za-z_-]*", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Chance that two letters of ordinary text are the same; of ordinary runs in a hex alphabet, which are mostly decimal numbers.
COINCIDENCE, COINCIDENCE_HEX = 0.065, 0.1
#: A uniform draw fails the battery this often; share of false ones among what is found.
ALPHA, LEVEL = 0.001, 0.01
#: Bins of the chance: BINS for each factor e, MOST in all.
BINS, MOST = 4, 400
#: Hits that are gone through one after another in a running sum.
STEP = 256


def _let(value: Column, of) -> Column:
    """``of`` the value, which is worked out once however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _running(lengths: Column) -> Column:
    """Starts and ends (start, stop) of hits from the lengths (gap, hit) before and of them, in time in proportion to their number."""
    zero = F.lit(0).cast("long")

    def add(acc: Column, x: Column) -> Column:
        start = F.element_at(acc, -1)["stop"] + x["gap"]
        return F.array_append(acc, F.struct(start.alias("start"), (start + x["hit"]).alias("stop")))

    def inside(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int")), lambda k: F.slice(all_, k * STEP + 1, STEP))
        sums = F.transform(parts, lambda c: F.aggregate(c, zero, lambda a, x: a + x["gap"] + x["hit"]))
        heads = F.aggregate(sums, F.array(zero), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))
        one = lambda c, h: F.slice(F.aggregate(F.coalesce(c, F.slice(all_, 1, 0)), F.array(F.struct(h.alias("start"), h.alias("stop"))), add), 2, STEP)
        return F.flatten(F.zip_with(parts, heads, one))

    return _let(lengths, inside)


def _places(text: Column, pattern: str, hits: Column, kind: int) -> Column:
    """array<struct<start, kind, end, hit>> of all leftmost non-overlapping matches, in code points."""
    size = lambda x: F.coalesce(F.char_length(x), F.lit(0)).cast("long")
    # After the last hit comes one more gap, which is left out.
    lengths = F.slice(F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(size(g).alias("gap"), size(h).alias("hit"))), F.lit(1), F.size(hits))
    return F.zip_with(hits, _running(lengths), lambda h, x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("end"), h.alias("hit")))


def _upper_tail(z: Column) -> Column:
    """Chance of a standard normal value over z, within 0.3 %."""
    x = F.abs(z)
    q = F.exp(-x * x / 2) / ((1 - 0.339) * x + 0.339 * F.sqrt(x * x + 5.51)) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, q).otherwise(1 - q)


def _sum(values: Column, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + of(v).cast("long"))


def _case(by: Column, of) -> Column:
    """What ``of`` gives for the encoding that ``by`` names."""
    out = F.when(by == ENCODINGS[0][0], of(ENCODINGS[0]))
    for e in ENCODINGS[1:]:
        out = out.when(by == e[0], of(e))
    return out


def tested(candidates: DataFrame) -> DataFrame:
    """Rows with a column ``hit``: adds encoding, size (of its alphabet), n, chi, z_runs, z_serial, battery (chance under a uniform draw), chance (under ordinary text).

    encoding is null, and the rest with it, for numbers and for mixed alphabets; null hits have none.
    """
    s = F.col("hit")
    encoding = F.when(s.rlike(f"^(?:{ENCODINGS[0][1]})$"), ENCODINGS[0][0])
    for name, like, _ in ENCODINGS[1:]:
        encoding = encoding.when(s.rlike(f"^(?:{like})$"), name)
    df = candidates.withColumn("encoding", encoding)
    df = df.withColumn("size", _case(F.col("encoding"), lambda e: F.lit(len(e[2])))).withColumn("n", F.char_length("hit"))
    letters = F.split(_case(F.col("encoding"), lambda e: F.lit(e[2])), "")
    counts = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.char_length("hit") - F.char_length(F.replace(F.col("hit"), c, F.lit(""))))
    values = F.transform(F.regexp_extract_all("hit", F.lit("(.)")), lambda c: F.instr(_case(F.col("encoding"), lambda e: F.lit(e[2])), c) - 1)
    df = df.withColumn("counts", counts).withColumn("values", F.when(F.col("encoding").isNotNull(), values))
    df = df.withColumn("high", F.transform("values", lambda v: F.when(2 * v >= F.col("size"), 1).otherwise(0)))
    pairs = lambda c, f: _sum(F.zip_with(F.slice(c, F.lit(1), F.col("n") - 1), F.slice(c, F.lit(2), F.col("n") - 1), f))
    df = df.select(
        "*", _sum(F.col("counts"), lambda c: c.cast("long") * c).alias("squares"), _sum(F.col("high")).alias("n1"), (1 + pairs(F.col("high"), lambda a, b: F.when(a == b, 0).otherwise(1))).alias("runs"),
        _sum(F.col("values")).alias("s1"), _sum(F.col("values"), lambda v: v.cast("long") * v).alias("s2"), pairs(F.col("values"), lambda a, b: a.cast("long") * b).alias("s12"),
        F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"))
    n, k, n1 = F.col("n").cast("double"), F.col("size").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    mean = 2 * n1 * n0 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    m = F.col("s1") / n
    #: Correlation of neighbours, both sides about the common mean.
    cross = F.col("s12") - m * (2 * F.col("s1") - F.col("first") - F.col("last")) + (n - 1) * m * m
    df = df.withColumn("chi", k * F.col("squares") / n - n)
    df = df.withColumn("z_chi", (F.col("chi") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    df = df.withColumn("z_runs", F.when(spread > 0, (F.col("runs") - mean) / F.sqrt(spread)).otherwise(F.sqrt(n)))
    variance = F.col("s2") - n * m * m
    df = df.withColumn("z_serial", F.when(variance > 0, (cross / variance + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n)))
    least = F.least(_upper_tail(F.col("z_chi")), 2 * _upper_tail(F.abs("z_runs")), 2 * _upper_tail(F.abs("z_serial")))
    excess = n * (k * F.when(F.upper("encoding") == "HEX", COINCIDENCE_HEX).otherwise(COINCIDENCE) - 1)
    df = df.withColumn("battery", F.when(F.col("encoding").isNotNull(), F.least(3 * least, F.lit(1.0))))
    df = df.withColumn("chance", _upper_tail(-(F.col("chi") - (k - 1) - excess) / F.sqrt(2 * (k - 1) + 4 * excess)))
    return df.drop("counts", "values", "high", "squares", "n1", "runs", "s1", "s2", "s12", "first", "last", "z_chi")


def stratum(encoding: Column, n: Column) -> Column:
    """Encoding and length band: lengths from a power of two to the next."""
    return F.concat(encoding, F.lit("/"), F.floor(F.log2(n)).cast("string"))


def bins(battery: Column, chance: Column) -> Column:
    """The bin of a chance, 0 for what fails the battery: chances of bin b are exp(-b / BINS) at most."""
    return F.when(battery >= ALPHA, F.least(F.floor(-F.log(chance) * BINS), F.lit(MOST))).otherwise(0).cast("int")


def cuts(counts: DataFrame, level: float = LEVEL) -> DataFrame:
    """(stratum, cut) from counts (stratum, bin, n): bins from ``cut`` on are found. Strata without any are left out."""
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    total = F.sum("n").over(Window.partitionBy("stratum"))
    passing = counts.select("stratum", "bin", (F.exp(-F.col("bin") / BINS) * total <= level * F.sum("n").over(down)).alias("ok"))
    return passing.where("ok AND bin > 0").groupBy("stratum").agg(F.min("bin").alias("cut"))


def _if_long(least: int):
    """A place where the text beside it has ``least`` characters, else null. (A default argument would be taken for an index.)"""
    return lambda place, counted: F.when(F.char_length(counted) >= least, place)


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the base kinds) and found (candidates) of each row."""
    text = text_or_empty()
    df = docs.select("doc_id", text.alias("text"))
    df = df.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"h{k}") for k, p in enumerate([*(b[0] for b in BASE.values()), CANDIDATE])))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")
    columns = []
    for k, (pattern, group, least) in enumerate(BASE.values()):
        hits = F.col(f"h{k}")
        if group:
            parts = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
            long = F.zip_with(_places(F.col("text"), pattern, hits, k), parts, _if_long(least))
        else:
            long = F.zip_with(_places(F.col("text"), pattern, hits, k), hits, _if_long(least))
        columns.append(F.when(F.size(hits) > 0, F.filter(long, lambda x: x.isNotNull())).otherwise(none))
    last = len(BASE)
    found = F.when(F.size(f"h{last}") > 0, _places(F.col("text"), CANDIDATE, F.col(f"h{last}"), last)).otherwise(none)
    return df.select("doc_id", F.concat(*columns).alias("base"), found.alias("found"))


def _digest(spans: Column) -> Column:
    """``kind:start:end`` in the order of start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, spans (array of start, kind number, end, hit, in code points, end exclusive) and n_base of every row's text.

    Base spans always stay; a ``random`` span is added where a candidate passes the tests and
    no base span holds it. A span of kind assign is the whole match, key word included. Null
    and empty texts have no spans; rows are kept as they come, repeated and null doc_ids
    included, equal candidates are counted each time. Other columns are dropped. Without
    rows there are no cuts and no rows.
    """
    held = staged(_matches(docs), "matches")
    strings = held.select(F.explode("found").alias("x")).select(F.col("x.hit").alias("hit")).groupBy("hit").agg(F.count("*").alias("times"))
    judged = staged(tested(strings).where("encoding IS NOT NULL").select("hit", "times", stratum(F.col("encoding"), F.col("n")).alias("stratum"), bins(F.col("battery"), F.col("chance")).alias("bin")), "judged")
    cut = cuts(judged.groupBy("stratum", "bin").agg(F.sum("times").alias("n")), level)
    good = judged.join(cut, "stratum").where(F.col("bin") >= F.col("cut")).select("hit")
    # Texts with a candidate are few; each candidate comes back to its row by the row's place in the stage table.
    keyed = held.withColumn("row", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    inside = lambda x: F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    new = keyed.select("row", F.explode(F.filter("found", lambda x: ~inside(x))).alias("x")).join(good, F.col("x.hit") == F.col("hit"), "left_semi").groupBy("row").agg(F.collect_list("x").alias("new"))
    out = keyed.join(new, "row", "left")
    return out.select("doc_id", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")))).alias("spans"), F.size("base").alias("n_base"))


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *(of(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The whole scan in SQL: matches and their places, the three tests, bins, and the cuts of each stratum."""
    quote = lambda p: p.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT {k} AS kind, doc_id, string_split_regex(t, '{quote(p)}') AS gaps, regexp_extract_all(t, '{quote(p)}') AS hits, regexp_extract_all(t, '{quote(p)}', {group}) AS parts, {least} AS least FROM d"
        for k, (p, group, least) in enumerate([*BASE.values(), (CANDIDATE, 0, 0)]))
    encoding = " ".join(f"WHEN regexp_full_match(hit, '{like}') THEN '{name}'" for name, like, _ in ENCODINGS)
    alphabet = " ".join(f"WHEN '{name}' THEN '{letters}'" for name, _, letters in ENCODINGS)
    tail = lambda z: f"CASE WHEN {z} >= 0 THEN exp(-({z}) * ({z}) / 2) / (0.661e0 * abs({z}) + 0.339e0 * sqrt(({z}) * ({z}) + 5.51e0)) / {math.sqrt(2 * math.pi)!r}e0 ELSE 1 - exp(-({z}) * ({z}) / 2) / (0.661e0 * abs({z}) + 0.339e0 * sqrt(({z}) * ({z}) + 5.51e0)) / {math.sqrt(2 * math.pi)!r}e0 END"
    names = "list_value(" + ", ".join(f"'{n}'" for n in KINDS) + ")[kind + 1]"
    listed = f"coalesce(string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
s AS MATERIALIZED (SELECT doc_id, kind, hits[i] AS hit, least, parts[i] AS part,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
p AS MATERIALIZED (SELECT doc_id, kind, hit, start, start + length(hit) AS stop FROM s WHERE length(part) >= least),
e AS (SELECT hit, count(*) AS times, CASE {encoding} END AS encoding FROM p WHERE kind = {len(BASE)} GROUP BY hit),
v AS (SELECT hit, times, encoding, CAST(length(hit) AS DOUBLE) AS n, CAST(length(a) AS DOUBLE) AS k, list_transform(range(1, length(hit) + 1), lambda i: instr(a, substr(hit, i, 1)) - 1) AS v
  FROM (SELECT *, CASE encoding {alphabet} END AS a FROM e WHERE encoding IS NOT NULL)),
c AS (SELECT *, CAST(list_sum(list_transform(list_distinct(v), lambda a: len(list_filter(v, lambda b: b = a)) * len(list_filter(v, lambda b: b = a)))) AS DOUBLE) AS squares,
  CAST(len(list_filter(v, lambda x: 2 * x >= k)) AS DOUBLE) AS n1, 1 + coalesce(list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN (2 * v[i] >= k) = (2 * v[i + 1] >= k) THEN 0 ELSE 1 END)), 0) AS runs,
  CAST(list_sum(v) AS DOUBLE) AS s1, CAST(list_sum(list_transform(v, lambda x: x * x)) AS DOUBLE) AS s2, CAST(list_sum(list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1])) AS DOUBLE) AS s12 FROM v),
z AS (SELECT *, k * squares / n - n AS chi, 2 * n1 * (n - n1) / n + 1 AS mean, s1 / n AS av, s2 - s1 * s1 / n AS var, n * (k * CASE WHEN upper(encoding) = 'HEX' THEN {COINCIDENCE_HEX}e0 ELSE {COINCIDENCE}e0 END - 1) AS excess FROM c),
y AS (SELECT *, (chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z1,
  abs(CASE WHEN (mean - 1) * (mean - 2) > 0 THEN (runs - mean) / sqrt((mean - 1) * (mean - 2) / (n - 1)) ELSE sqrt(n) END) AS z2,
  abs(CASE WHEN var > 0 THEN ((s12 - av * (2 * s1 - v[1] - v[-1]) + (n - 1) * av * av) / var + 1 / n) * sqrt(n) ELSE sqrt(n) END) AS z3, -(chi - (k - 1) - excess) / sqrt(2 * (k - 1) + 4 * excess) AS z4 FROM z),
b AS MATERIALIZED (SELECT hit, times, encoding || '/' || CAST(floor(log2(n)) AS BIGINT) AS stratum,
  CASE WHEN least(3 * least({tail("z1")}, 2 * ({tail("z2")}), 2 * ({tail("z3")})), 1e0) >= {ALPHA}e0 THEN CAST(least(floor(-ln({tail("z4")}) * {BINS}), {MOST}) AS INTEGER) ELSE 0 END AS bin FROM y),
h AS (SELECT stratum, bin, sum(times) AS n FROM b GROUP BY ALL),
u AS (SELECT stratum, min(bin) AS cut FROM (SELECT stratum, bin, exp(-bin / {BINS}e0) * sum(n) OVER (PARTITION BY stratum) <= {LEVEL}e0 * sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS ok FROM h) WHERE ok AND bin > 0 GROUP BY stratum),
g AS (SELECT hit FROM b JOIN u USING (stratum) WHERE bin >= cut),
f AS (SELECT * FROM p WHERE kind < {len(BASE)} UNION ALL SELECT p.* FROM p WHERE kind = {len(BASE)} AND hit IN (SELECT hit FROM g)
  AND NOT EXISTS (SELECT 1 FROM p AS o WHERE o.doc_id = p.doc_id AND o.kind < {len(BASE)} AND o.start <= p.start AND p.stop <= o.stop))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{n}" for k, n in enumerate(BASE))}, sha256({listed} FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256, {listed} FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLE_SQL = _oracle()
