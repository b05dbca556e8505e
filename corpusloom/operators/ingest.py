"""Choosing and sampling raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a path that mark a text field, its bonus, the least length, and items read of a list.
TEXT_WORDS = ("text", "opinion", "casebody", "html", "plain")
BONUS, LEAST_CHARS, LIST_ITEMS = 50_000, 500, 20
METADATA_KEYS = ("id", "name", "case_name", "court", "court_id", "date_filed", "decision_date", "citation", "citations", "docket_number")
#: Fixed value: tokens that a corpus should have.
WANTED_TOKENS = 2_000_000
#: Ranges that tell how far to read; rows that one task numbers at most to cut a sample off.
RANGES, NUMBERED = 1024, 50_000

#: Levels of a variant that are looked into.
DEPTH = 16

_FIELD = "struct<path:string,value:string>"


def _variant_fields(v: Column, path: Column, depth: int = 0) -> Column:
    """Strings of a value of any shape: of each member of an object, by key, or of a list's first items."""
    items = F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, LIST_ITEMS)
    entry = lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))
    members = F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.transform(items, entry))
    one = F.when(F.schema_of_variant(v) == "STRING", F.array(F.struct(path.alias("path"), F.try_variant_get(v, "$", "string").alias("value"))))
    none = F.array().cast(f"array<{_FIELD}>")
    if depth == DEPTH:
        deeper = F.raise_error(F.lit(f"a record is nested deeper than {DEPTH} levels"))
        return F.coalesce(F.when(F.size(members) > 0, deeper.cast(f"array<{_FIELD}>")), one, none)
    below = lambda e: F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"]))
    held = F.transform(members, lambda e: F.struct(below(e).alias("path"), e["value"].alias("value")))
    return F.coalesce(F.flatten(F.transform(held, lambda e: _variant_fields(e["value"], e["path"], depth + 1))), one, none)


def _fields(c: Column, kind: T.DataType, path: Column) -> Column | None:
    below = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit("." + name)))
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.array(F.struct(path.alias("path"), c.alias("value")))).otherwise(F.array().cast(f"array<{_FIELD}>"))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _fields(c[f.name], f.dataType, below(f.name))) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _fields(F.lit(None).cast(kind.elementType), kind.elementType, F.lit("")) is None:
            return None
        at = lambda i: F.when(path == "", i.cast("string")).otherwise(F.concat(path, F.lit("."), i.cast("string")))
        items = F.transform(F.slice(c, 1, LIST_ITEMS), lambda x, i: _fields(x, kind.elementType, at(i)))
        return F.coalesce(F.flatten(items), F.array().cast(f"array<{_FIELD}>"))
    if isinstance(kind, T.MapType):
        if _fields(F.lit(None).cast(kind.valueType), kind.valueType, F.lit("")) is None:
            return None
        at = lambda k: F.when(path == "", k.cast("string")).otherwise(F.concat(path, F.lit("."), k.cast("string")))
        items = F.transform(F.map_entries(c), lambda e: _fields(e["value"], kind.valueType, at(e["key"])))
        return F.coalesce(F.flatten(items), F.array().cast(f"array<{_FIELD}>"))
    if isinstance(kind, T.VariantType):
        return _variant_fields(c, path)
    return None


def string_fields(df: DataFrame, *columns: str) -> Column:
    """array<(path, value)> of all strings in the columns, in order; lists are cut to their first 20 items.

    Columns may be strings, structs, maps, lists of these, or variants (records of unknown shape, ``parse_json``) at the top
    or in structs; other types hold no strings.
    """
    parts = [p for c in (columns or df.columns) if (p := _fields(F.col(c), df.schema[c].dataType, F.lit(c))) is not None]
    return F.concat(*parts) if parts else F.array().cast(f"array<{_FIELD}>")


def choose_text_field(fields: Column) -> Column:
    """The (path, text) of cleaned fields that scores best, or null: length, and a bonus for telling paths.

    ``fields`` is array<(path, value)> with cleaned values; of equal scores the first one wins.
    """
    told = lambda p: F.lit(False) if not TEXT_WORDS else F.lower(p).rlike("|".join(TEXT_WORDS))
    long = F.filter(fields, lambda f: F.length(f["value"]) >= LEAST_CHARS)
    scored = F.transform(
        long, lambda f, i: F.struct((F.length(f["value"]) + F.when(told(f["path"]), BONUS).otherwise(0)).alias("score"), (-i).alias("first"), f["path"].alias("path"), f["value"].alias("text"))
    )
    best = F.array_max(scored)
    return F.when(best.isNotNull(), F.struct(best["path"].alias("path"), best["text"].alias("text")))


def compact_metadata(df: DataFrame, selected: Column) -> Column:
    """A struct of the known metadata columns that ``df`` has, and of the selected field."""
    return F.struct(selected.alias("selected_text_field"), *[F.col(k) for k in METADATA_KEYS if k in df.columns])


def running_before(df: DataFrame, order: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, by ``order``.

    Rows are dealt into ranges; the ranges' totals are added up, one row a range, and only then each range runs through
    its own rows.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges' first values, read once: a range exchange that is made anew draws other bounds
    dealt = df.select(order).where(F.col(order).isNotNull()).repartitionByRange(n, order)
    firsts = sorted(r[0] for r in dealt.groupBy(F.spark_partition_id().alias("loom_part")).agg(F.min(order).alias("first")).select("first").collect())
    part = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= F.col(order))) if firsts else F.lit(0)
    ranged = df.withColumn("loom_part", part)
    totals = ranged.groupBy("loom_part").agg(F.min(order).alias("loom_first"), F.sum(value).alias("loom_sum"))
    before = F.coalesce(F.sum("loom_sum").over(Window.orderBy("loom_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select("loom_part", before.alias("loom_before")))  # one row a range
    inside = Window.partitionBy("loom_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("loom_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "loom_part")
        .withColumn(out, F.col("loom_in") + F.col("loom_before"))
        .drop("loom_part", "loom_in", "loom_before")
    )


def reading_end(df: DataFrame, order: str, value: str, target: int) -> int | None:
    """A bound of a whole-number column up to which the values add up to the target; none if all of them do not.

    One pass over the two columns adds up RANGES ranges between the least and the largest; the bound is the end of a range.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return None
    width = max(1, -(-(high - low + 1) // RANGES))
    part = F.floor((F.col(order).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
    total = 0
    for r in sorted(df.where(F.col(order).isNotNull()).groupBy(part.alias("part")).agg(F.sum(value).alias("n")).collect(), key=lambda r: r["part"]):
        total += r["n"] or 0
        if total >= target:
            return min(high, low + (r["part"] + 1) * width - 1)
    return None


def take_until_tokens(df: DataFrame, order: str, target: int, max_records: int | None = None, tokens: str = "token_count") -> DataFrame:
    """Rows in order until their tokens reach the target; the row that crosses it is kept.  Order values must differ.

    With a whole number as order, totals of ranges tell first how far to read, and the rest is a filter on the order, which
    a scan of files sorted by it turns into files and row groups that it does not read.  Rows are dealt out up to that bound
    only.  Null tokens count nothing; null orders come first.
    """
    if isinstance(df.schema[order].dataType, T.IntegralType) and (end := reading_end(df, order, tokens, target)) is not None:
        df = df.where(F.col(order).isNull() | (F.col(order) <= end))
    kept = running_before(df, order, tokens, "loom_total").where(F.col("loom_total") < target).drop("loom_total")
    return kept.orderBy(order).limit(max_records) if max_records is not None else kept


def corpus_report(kept: DataFrame, target: int = WANTED_TOKENS, index: str = "record_index", tokens: str = "token_count") -> DataFrame:
    """One row: tokens, records kept, scanned and skipped, and whether the tokens suffice."""
    row = kept.agg(
        F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("written_records"),
        F.coalesce(F.max(index), F.lit(0)).cast("long").alias("scanned_records"),
    )
    return row.select("*", (F.col("scanned_records") - F.col("written_records")).alias("skipped_records"), (F.col("total_tokens") >= target).alias("enough"))


def _leading(by: Column, kind: T.DataType) -> Column:
    """A long that keeps the order of whole numbers, strings and bytes; values of one long may differ."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(by.cast("long"), F.lit(-(1 << 63)))
    if not isinstance(kind, T.StringType | T.BinaryType):
        raise ValueError("a sample is ordered by a whole number, a string or bytes")
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(by.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1))


def sample_n(df: DataFrame, n: int, seed: int, key: str = "id", by: Column | None = None) -> DataFrame:
    """A sample of n rows that depends on keys and seed alone: the n least by ``by``, a hash, and by key.

    Counts of ranges of the hash tell which rows are in; a range that the n-th row cuts is looked at in finer ranges, until
    a task can number the rest of it, so no task sorts the sample.  A table of fewer rows comes whole.  Rows that are equal
    in both are taken in any order.  Null keys are rows like others, null hashes come first.
    """
    by = by if by is not None else F.xxhash64(F.col(key), F.lit(seed))
    hashed = df.withColumn("loom_by", by)
    rows = hashed.withColumn("loom_at", _leading(F.col("loom_by"), hashed.schema["loom_by"].dataType))
    kept, inside, need, shift = F.lit(False), F.lit(True), n, 48
    while need > 0:
        part = F.shiftright("loom_at", shift)
        total, cut = 0, None
        for r in sorted(rows.where(inside).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
            if total + r["n"] > need:
                cut = r
                break
            total += r["n"]
        if cut is None:
            kept, need = kept | inside, 0
            break
        kept, inside, need = kept | (inside & (part < cut["part"])), inside & (part == cut["part"]), need - total
        if cut["n"] <= NUMBERED or shift == 0:
            break
        shift -= 16
    out = rows.where(kept)
    if need > 0:
        numbered = rows.where(inside).withColumn("loom_n", F.row_number().over(Window.partitionBy(F.shiftright("loom_at", shift)).orderBy("loom_by", key)))
        out = out.unionByName(numbered.where(F.col("loom_n") <= need).drop("loom_n"))
    return out.drop("loom_by", "loom_at")
