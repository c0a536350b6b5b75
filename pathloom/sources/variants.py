"""JSON documents of any shape as rows of paths: no schema, so wrong types and unknown fields stay visible."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a row of a document says: its path, the path with [*] for every index, those of its container, its key in an object, its type, its text and how many parts it has.
ROW = ("doc", "path", "place", "above", "above_place", "key", "type", "text", "size")


def documents(texts: DataFrame) -> DataFrame:
    """(doc, value) from (doc, text); a text that is no JSON gives a null value."""
    return texts.select("doc", F.try_parse_json("text").alias("value"))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, INTEGER or NUMBER; null for a null value."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)
    return F.when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "INTEGER").when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(name)


def _text(value: Column, kind: Column, number: Column) -> Column:
    """A scalar's text: strings as they are, equal numbers alike however they are written, null for containers; ``number``: the value of a NUMBER."""
    whole = (number == F.floor(number)) & (F.abs(number) < float(1 << 53))
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "NUMBER", F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))).when(kind.isin("INTEGER", "BOOLEAN"), F.try_variant_get(value, "$", "string")).when(~kind.isin("OBJECT", "ARRAY"), F.to_json(value))


def _step(key: Column) -> Column:
    return F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), key, F.lit('"')))


def unfolded(docs: DataFrame, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """One row (ROW) for each value inside of documents (doc, value): one round for each level of depth, all documents at once.

    Keys that are no plain names stand in quotes. A null value of a document is a row without type. The parts of a container become rows of
    their own, so a document of many parts is dealt over tasks after its first level; the document itself, a variant, has a limit of 16 MiB in Spark.
    """
    spark = docs.sparkSession
    none = F.lit(None).cast("string")
    level = docs.select("doc", F.lit("$").alias("path"), F.lit("$").alias("place"), none.alias("above"), none.alias("above_place"), none.alias("key"), "value")
    out = None
    while True:
        level = level.withColumn("type", _kind(F.col("value")))
        parts = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.map_values(F.try_variant_get("value", "$", "map<string,variant>")))
        size = F.when(F.col("type").isin("OBJECT", "ARRAY"), F.coalesce(F.size(parts), F.lit(0)))
        # Read once, as a column: the text needs it in four places.
        level = level.withColumn("number", F.when(F.col("type") == "NUMBER", F.try_variant_get("value", "$", "double")))
        level = checkpoint(level.withColumn("text", _text(F.col("value"), F.col("type"), F.col("number"))).withColumn("size", size).drop("number"))
        rows = level.select(*ROW)
        out = rows if out is None else out.unionByName(rows)
        inner = level.where("size > 0")
        if inner.isEmpty():
            return out
        # An outer column goes under another name, so that it does not meet the columns of the parts.
        inner = inner.select("doc", F.col("path").alias("above"), F.col("place").alias("above_place"), F.col("value").alias("whole"))
        each = inner.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer())).drop("whole")
        inside = F.col("key").isNotNull()
        level = each.select(
            "doc", F.concat("above", F.when(inside, _step(F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"),
            F.concat("above_place", F.when(inside, _step(F.col("key"))).otherwise(F.lit("[*]"))).alias("place"), "above", "above_place", "key", "value")


def compared(before: DataFrame, after: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(doc, path, before, after) where two sets of unfolded documents differ: scalars and empty containers, as type and text; null where there is none.

    Places that match a pattern of ``volatile``, and what is inside of them, are left out.
    """
    def leaves(rows: DataFrame, name: str) -> DataFrame:
        for p in volatile:
            rows = rows.where(~F.col("place").rlike(f"^(?:{p})(?:$|[.\\[])"))
        kind = F.when(F.col("type").isin("INTEGER", "NUMBER"), "NUMBER").otherwise(F.coalesce("type", F.lit("NONE")))
        return rows.where("size IS NULL OR size = 0").select("doc", "path", F.concat_ws(" ", kind, "text").alias(name))

    both = leaves(before, "before").join(leaves(after, "after"), ["doc", "path"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, before, after) of two sets of documents (doc, value): each side a struct of the value, null where a set lacks the document."""
    side = lambda docs, name: docs.select("doc", F.struct("value").alias(name))
    return side(before, "before").join(side(after, "after"), "doc", "full")


#: Levels that one pass goes down before its rows are stored.
LEVELS = 3


def changes(pairs: DataFrame, volatile: tuple[str, ...] = (), checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """What ``compared`` says of the unfolded documents, from ``paired`` ones with a row for each document.

    Both values go down ``LEVELS`` levels in one pass and meet by path where their document lies, so that no leaves are dealt anew; only what differs, or is open below, is stored.
    """
    spark = pairs.sparkSession
    side = lambda after, name: F.struct(F.lit(after).alias("late"), F.col(name).isNotNull().alias("there"), F.col(f"{name}.value").alias("value"))
    rows = pairs.select("doc", F.lit("$").alias("path"), F.lit("$").alias("place"), F.inline(F.array(side(False, "before"), side(True, "after")))).where("there").drop("there")
    out = None

    def steady(rows, known=F.lit(False)):
        for p in volatile:
            rows = rows.where(known | ~F.col("place").rlike(f"^(?:{p})(?:$|[.\\[])"))
        return rows

    rows = steady(rows)
    while True:
        for _ in range(LEVELS):
            # A value without parts comes through as it is.
            each = rows.withColumnRenamed("value", "whole").lateralJoin(spark.tvf.variant_explode_outer(F.col("whole").outer()))
            own = F.col("pos").isNull()
            to = lambda index: F.when(F.col("key").isNotNull(), _step(F.col("key"))).otherwise(index)
            rows = steady(each.select(
                "doc", "late", F.when(own, F.col("path")).otherwise(F.concat("path", to(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))).alias("path"),
                F.when(own, F.col("place")).otherwise(F.concat("place", to(F.lit("[*]")))).alias("place"), F.when(own, F.col("whole")).otherwise(F.col("value")).alias("value"), own.alias("own")), F.col("own")).drop("own")
        rows = rows.withColumn("type", _kind(F.col("value")))
        rows = rows.withColumn("number", F.when(F.col("type") == "NUMBER", F.try_variant_get("value", "$", "double")))
        sized = lambda kind: F.try_variant_get("value", "$", kind)
        rows = rows.withColumn("open", F.when(F.col("type") == "OBJECT", F.array_size(F.map_keys(sized("map<string,variant>"))) > 0).when(F.col("type") == "ARRAY", F.array_size(sized("array<variant>")) > 0).otherwise(False))
        kind = F.when(F.col("type").isin("INTEGER", "NUMBER"), "NUMBER").otherwise(F.coalesce("type", F.lit("NONE")))
        rows = rows.withColumn("text", F.when(~F.col("open"), F.concat_ws(" ", kind, _text(F.col("value"), F.col("type"), F.col("number")))))
        of = lambda late, column: F.when(F.col("late") == late, F.col(column))
        part = lambda late: F.first(F.when(F.col("open"), of(late, "value")), True)
        met = rows.groupBy("doc", "path").agg(
            F.max(of(False, "text")).alias("before"), F.max(of(True, "text")).alias("after"), F.first(F.when(F.col("open"), F.col("place")), True).alias("place"), part(False).alias("b"), part(True).alias("a"))
        met = checkpoint(met.where("place IS NOT NULL OR NOT (before <=> after)"))
        found = met.where("NOT (before <=> after)").select("doc", "path", "before", "after")
        out = found if out is None else out.unionByName(found)
        rest = met.where("place IS NOT NULL")
        if rest.isEmpty():
            return out
        rows = rest.select("doc", "path", "place", F.inline(F.array(*[F.struct(F.lit(late).alias("late"), F.col(v).alias("value")) for late, v in ((False, "b"), (True, "a"))]))).where("value IS NOT NULL")


def first_difference(differences: DataFrame) -> DataFrame:
    """(doc, path, n) of documents that differ: the least differing path and how many there are."""
    return differences.groupBy("doc").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def _quoted(text: Column) -> Column:
    """A string as JSON in ASCII: short escapes, and \\uXXXX in lower case, two of them beyond the basic plane."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        wide = F.concat(unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))))
        out = F.when((code >= 0x20) & (code < 0x7F) & ~c.isin('"', "\\"), c)
        for plain, escaped in named.items():
            out = out.when(c == plain, F.lit(escaped))
        return out.when(code < 0x10000, unit(code)).otherwise(wide)

    # Most texts need no escapes.
    easy = text.rlike(r'\A[\x20\x21\x23-\x5B\x5D-\x7E]*\z')
    return F.concat(F.lit('"'), F.when(easy, text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)")), one), "")), F.lit('"'))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decimal(text: Column) -> Column:
    """A double's text in its shortest digits (a negative zero loses its sign in a variant), plain from 1e-4 up to 1e16 and with a two-digit exponent beyond: 35.0, 1e-05, 1.5e+16.

    A plain text of 15 digits at most is its number's shortest: no two such texts give the same double.
    """
    whole, short = text.rlike(r"\A-?[0-9]{1,15}\z"), text.rlike(r"\A(?=.{1,16}\z)-?(0|[1-9][0-9]*)\.[0-9]*[1-9]\z") & ~text.rlike(r"\A-?0\.0000")
    return F.when(whole, F.concat(text, F.lit(".0"))).when(short, text).otherwise(_let(text.try_cast("double"), _digits))


def _digits(number: Column) -> Column:
    # The fewest digits of 15, 16 and 17 that give the number back.
    def fewest(size, *forms):
        return F.format_string(forms[-1], size) if len(forms) == 1 else _let(F.format_string(forms[0], size), lambda t: F.when(t.try_cast("double") == size, t).otherwise(fewest(size, *forms[1:])))

    def written(m):
        digits, power = m["digits"], m["power"]
        padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
        after = F.substring(padded, power + 2, F.lit(400))
        long = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.when(after == "", "0").otherwise(after))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        front = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 400))).otherwise(digits)
        far = F.concat(front, F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        return F.when((power >= 0) & (power < 16), long).when((power < 0) & (power >= -4), small).otherwise(far)

    def parted(raw):
        digits = F.regexp_replace(F.replace(F.split_part(raw, F.lit("e"), F.lit(1)), F.lit("."), F.lit("")), "0+$", "")
        return F.struct(F.when(digits == "", "0").otherwise(digits).alias("digits"), F.split_part(raw, F.lit("e"), F.lit(2)).try_cast("int").alias("power"))

    raw = fewest(F.abs(number), "%.14e", "%.15e", "%.16e")
    return F.concat(F.when(number < 0, "-").otherwise(""), _let(_let(raw, parted), written))


def canonical(rows: DataFrame, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(doc, text): each unfolded document as compact JSON with sorted keys, in ASCII: the text that digests are taken of.

    Containers are put together from their parts level by level, the deepest first, all documents at once.
    """
    steps = F.size(F.regexp_extract_all("place", F.lit(r'(\[\*\]|\."[^"]*"|\.[A-Za-z0-9_]+)')))
    depth = F.when(F.col("place").contains('"'), steps).otherwise(F.length("place") - F.length(F.translate("place", ".[", "")))
    at = F.rtrim(F.substring_index("path", "[", -1), F.lit("]")).try_cast("long")
    scalar = F.when(F.col("type") == "STRING", _quoted(F.col("text"))).when(F.col("type") == "NUMBER", _decimal(F.col("text"))).when(F.col("size") == 0, F.when(F.col("type") == "OBJECT", "{}").otherwise("[]")).otherwise(F.coalesce("text", F.lit("null")))
    told = checkpoint(rows.select("doc", "path", "above", "key", "type", "size", depth.alias("depth"), F.when(F.col("key").isNull(), at).alias("at"), scalar.alias("json")))
    deepest = told.agg(F.max("depth")).first()[0] or 0
    ready = told.where(F.col("depth") == deepest)
    for d in range(deepest, 0, -1):
        name = F.when(F.col("key").isNotNull(), F.concat(_quoted(F.col("key")), F.lit(":"), F.col("json"))).otherwise(F.col("json"))
        parts = ready.groupBy("doc", F.col("above").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "key", name.alias("j")))), lambda x: x["j"]), ",").alias("inner"))
        # Only containers with parts meet them.
        upper = told.where(F.col("depth") == d - 1)
        whole = F.when(F.col("type") == "OBJECT", F.concat(F.lit("{"), "inner", F.lit("}"))).otherwise(F.concat(F.lit("["), "inner", F.lit("]")))
        full = upper.where("size > 0").join(parts, ["doc", "path"], "left").withColumn("json", F.when(F.col("inner").isNotNull(), whole).otherwise(F.col("json"))).select(*told.columns)
        ready = checkpoint(upper.where("size IS NULL OR size = 0").unionByName(full))
    return ready.where("path = '$'").select("doc", F.col("json").alias("text"))


#: Levels below a document's own that ``texts`` goes down where the document lies.
DEPTH = 4


def _written(value: Column, levels: int) -> Column:
    """The canonical text of a value whose parts go ``levels`` deep at most; null for one that goes deeper."""

    def scalar(kind: Column) -> Column:
        number = F.when(kind == "NUMBER", F.try_variant_get(value, "$", "double"))
        return _let(_text(value, kind, number), lambda text: F.when(kind == "STRING", _quoted(text)).when(kind == "NUMBER", _decimal(text)).otherwise(F.coalesce(text, F.lit("null"))))

    def whole(kind: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<variant>")
        entries = F.when(kind == "ARRAY", F.transform(items, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))).otherwise(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")))
        ends = lambda inner: F.when(kind == "OBJECT", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
        if not levels:
            return F.when(F.size(entries) == 0, ends(F.lit("")))

        def part(x: Column, k: Column) -> Column:
            name = F.when(x["key"].isNull(), "").otherwise(F.concat(_quoted(x["key"]), F.lit(":")))
            return F.struct(F.when(x["key"].isNull(), k).alias("at"), x["key"].alias("key"), F.concat(name, _written(x["value"], levels - 1)).alias("j"))

        return _let(F.transform(entries, part), lambda parts: F.when(~F.exists(parts, lambda x: x["j"].isNull()), ends(F.array_join(F.transform(F.array_sort(parts), lambda x: x["j"]), ","))))

    return _let(_kind(value), lambda kind: F.when(kind.isin("OBJECT", "ARRAY"), whole(kind)).otherwise(scalar(kind)))


def texts(docs: DataFrame, told=lambda text: text, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(doc, text): ``canonical`` of documents (doc, value), each written where it lies, so that no parts are stored or dealt; those deeper than DEPTH levels go the way of ``unfolded``.

    ``told`` is what is kept of a text, such as its digest: only that is stored.
    """
    # What is no document has the text of a null.
    found = docs.select("doc", "value", F.when(F.col("value").isNull(), "null").otherwise(_written(F.col("value"), DEPTH)).alias("text"))
    stored = checkpoint(found.select("doc", told(F.col("text")).alias("text"), F.when(F.col("text").isNull(), F.col("value")).alias("value")))
    deep = stored.where("value IS NOT NULL")
    near = stored.where("value IS NULL").select("doc", "text")
    if deep.isEmpty():
        return near
    return near.unionByName(canonical(unfolded(deep.select("doc", "value"), checkpoint), checkpoint).select("doc", told(F.col("text")).alias("text")))
