"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in text, and the white space stripped from text.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?)|inf|infinity)\s*$"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Text longer than this is keyed by its digest, so long documents are not shuffled to be counted.
LONG_TEXT = 64


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if is_integer(t):
        return "integer"
    if isinstance(t, T.NumericType):
        return "float"
    if is_datetime(t):
        return "datetime"
    if is_text(t):
        return "string"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans do not count as numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value instead of two: NaN becomes null."""
    if not any(is_float(f.dataType) for f in df.schema):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name) if is_float(f.dataType) else col(f.name)
            for f in df.schema
        ]
    )


def as_number(c: Column) -> Column:
    """Text to double; null where the text is no number (suffixes such as '1d' are no numbers)."""
    return F.when(c.rlike(NUMBER_PATTERN), F.btrim(c, F.lit(WHITESPACE)).try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as a double: parsed from text, 0/1 for booleans, null where that fails."""
    t = type_of(df, name)
    if is_text(t):
        return as_number(col(name))
    if isinstance(t, T.BooleanType):
        return col(name).cast("int").cast("double")
    if not isinstance(t, T.NumericType):
        return F.lit(None).cast("double")
    v = col(name).cast("double")
    return F.when(~F.isnan(v), v) if is_float(t) else v


# Accepted date formats in text, each with the shape that selects it; where there are two, the month comes
# first in the one and the day in the other.
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", ["M/d/yyyy H:mm", "d/M/yyyy H:mm"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", ["M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["d.M.yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", ["MMM d, yyyy"]),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", ["MMMM d, yyyy"]),
]
# Cheap first look: digits, a separator, something short, a separator, a digit; or a month name and a day.
DATE_LIKE = r"^(\d{1,4}[-/. ][0-9A-Za-z]{1,3}[-/. ]\d|[A-Za-z]{3,9} \d)"
LIKELY = f"^[{WHITESPACE}]*{DATE_LIKE[1:]}"
# Dates that can only have the day first, or only the month.
DAY_OR_MONTH = (r"^(1[3-9]|2\d|3[01])([/-])(0?[1-9]|1[0-2])\2\d{4}\b", r"^(0?[1-9]|1[0-2])([/-])(1[3-9]|2\d|3[01])\2\d{4}\b")
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?$"


def _parsed(s: Column, formats: list[tuple[str, str]], native: bool) -> Column:
    """Stripped text to timestamp by (shape, format), and by the native reader for ISO dates."""
    out = F.when(s.rlike(ISO_DATE), s.try_cast("timestamp")) if native else F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, one in formats:
        out = out.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(one)))
    return out


def as_timestamp(c: Column, day_first: bool = False) -> Column:
    """Text to timestamp by an explicit list of formats; null where none fits. Where month and day could change places,
    `day_first` decides for all values alike. Only text that starts like a date is stripped and looked at further."""
    formats = [(shape, formats[-1 if day_first else 0]) for shape, formats in DATE_FORMATS]
    return F.when(c.rlike(LIKELY), _parsed(strip(c), formats, True))


def date_like(c: Column) -> Column:
    """How many values of a text column are dates, in the order of month and day that suits more of them. Only the forms in
    which these could change places are read twice."""
    def count(formats: list[tuple[str, str]], native: bool) -> Column:
        return F.count_if(c.rlike(LIKELY) & _parsed(strip(c), formats, native).isNotNull())

    turned = [(shape, formats) for shape, formats in DATE_FORMATS if len(formats) > 1]
    return count([(shape, f[0]) for shape, f in DATE_FORMATS if len(f) == 1], True) + F.greatest(
        *[count([(shape, f[k]) for shape, f in turned], False) for k in (0, 1)])


def day_first(df: DataFrame, names: list[str]) -> set[str]:
    """The text columns in which more values are dates with the day before the month than the other way round, found by
    one aggregate. Only values with a part above 12 can tell, so a column without any is read month first."""
    texts = [n for n in names if is_text(type_of(df, n))]
    if not texts:
        return set()
    parts = [F.struct(*[F.count_if(F.btrim(col(n), F.lit(WHITESPACE)).rlike(shape)) for shape in DAY_OR_MONTH]) for n in texts]
    found = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).first()
    return {n for i, n in enumerate(texts) if found[f"c{i}"][0] > found[f"c{i}"][1]}


def moment_in_time(df: DataFrame, name: str, day_first: bool = False) -> Column:
    """The column as a wall-clock timestamp, parsed when it is text."""
    t = type_of(df, name)
    c = as_timestamp(col(name), day_first) if is_text(t) else col(name)
    return c if isinstance(t, T.TimestampNTZType) else c.cast("timestamp_ntz")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def as_text(df: DataFrame, name: str) -> Column:
    """A text form in which equal values, and only those, are equal."""
    t = type_of(df, name)
    if is_float(t):
        v = col(name)
        return F.when(~F.isnan(v), F.when(v == 0, F.lit(0.0).cast(t)).otherwise(v)).cast("string")
    if is_nested(t):
        return F.to_json(F.struct(col(name).alias("v"))) if not isinstance(t, T.BinaryType) else F.hex(col(name))
    return col(name).cast("string")


def text_key(c: Column) -> Column:
    """A short grouping key: the text itself, or the SHA-256 digest of a long one."""
    return F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(F.concat(F.lit("="), c))


def round_to(c: Column | str, digits: int) -> Column:
    """Round with halves to even, as Python and numpy do; negative zero becomes zero."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.rint(c * scale) / scale + F.lit(0.0)


def row_key(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns to group whole rows by; long text enters as its digest."""
    keys = []
    for n in names or df.columns:
        t = type_of(df, n)
        if is_text(t):
            keys.append(text_key(col(n)).alias(n))
        elif isinstance(t, (T.MapType, T.VariantType)):
            keys.append(F.to_json(F.struct(col(n).alias("v"))).alias(n))
        else:
            keys.append(col(n))
    return keys


def tidy(df: DataFrame, rows: list[Column], per_aggregate: int = 4) -> DataFrame:
    """One result row per element of `rows` (structs of aggregates).

    A few elements share an aggregate. Each aggregate scans only the columns it needs, and its generated
    code stays small enough to be compiled well, which one aggregate over all columns is not.
    """
    chunks = [rows[i : i + per_aggregate] for i in range(0, len(rows), per_aggregate)]
    parts = [df.agg(F.array(*chunk).alias("rows")).select(F.inline("rows")) for chunk in chunks]
    return reduce(DataFrame.unionAll, parts)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _keyed(df: DataFrame, keys: dict[str, Column], slot: dict[str, str]) -> DataFrame:
    """One row for each value that isn't null of each column: (column, long, double, text), the value in one of the three.
    All columns come from one scan."""
    def entry(name: str) -> Column:
        own = slot[name]
        return F.struct(F.lit(name).alias("column"), *[
            (keys[name] if kind == own else F.lit(None)).cast(t).alias(kind)
            for kind, t in (("long", "long"), ("double", "double"), ("text", "string"))])

    rows = df.select(F.inline(F.array(*[entry(n) for n in keys])))
    return rows.filter(F.col("long").isNotNull() | F.col("double").isNotNull() | F.col("text").isNotNull())


def _slot_of(t: T.DataType) -> str:
    return "long" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.DoubleType) else "text"


def value_counts(df: DataFrame, names: list[str], short: bool = False) -> DataFrame:
    """(column, value, n) with values as text. `short` replaces long text by its digest."""
    keys, slots = {}, {}
    for name in names:
        t = type_of(df, name)
        key = col(name) if not is_nested(t) else as_text(df, name)
        if is_float(t):
            key = F.when(~F.isnan(key), key)
        keys[name], slots[name] = text_key(key) if short and is_text(t) else key, _slot_of(t)
    counts = _keyed(df, keys, slots).groupBy("column", "long", "double", "text").agg(F.count("*").alias("n"))
    return counts.select("column", F.coalesce("text", F.col("long").cast("string"), F.col("double").cast("string")).alias("value"), "n")


def modes(df: DataFrame, names: list[str]) -> dict[str, object]:
    """{column: most frequent value, the least of several}, from one scan of all columns; numbers as such, others as text."""
    keys, slots = {}, {}
    for name in names:
        t = type_of(df, name)
        key = as_text(df, name) if is_nested(t) else col(name)
        keys[name], slots[name] = F.when(~F.isnan(key), key) if is_float(t) else key, _slot_of(t)
    counts = _keyed(df, keys, slots).groupBy("column", "long", "double", "text").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "long", "double", "text")).alias("best")
    rows = counts.groupBy("column").agg(best).select("column", "best.*").collect()  # a row a column
    return {r["column"]: next(v for v in (r["long"], r["double"], r["text"]) if v is not None) for r in rows}


def number_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) with values as doubles."""
    entries = [F.struct(F.lit(n).alias("column"), number(df, n).alias("value")) for n in names]
    rows = df.select(F.inline(F.array(*entries))).filter("value IS NOT NULL")
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, unique_count) without nulls; a column without values has none."""
    keys, slots = {}, {}
    for name in names:
        t = type_of(df, name)
        key = text_key(col(name)) if is_text(t) else as_text(df, name) if is_nested(t) else col(name)
        if is_float(t):
            key = F.when(~F.isnan(key), key)
        keys[name], slots[name] = key, _slot_of(t)
    values = _keyed(df, keys, slots).groupBy("column", "long", "double", "text").agg(F.lit(1).alias("one"))
    counts = values.groupBy("column").agg(F.count("*").alias("unique_count"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    return every.join(F.broadcast(counts), "column", "left").select("column", F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count"))
