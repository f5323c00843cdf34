"""Reading, validating and writing tables."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.staging import shared_folder
from colscope.sources import records

MIN_ROWS = 10
MIN_COLUMNS = 2


def deduplicated_names(names: list[str]) -> list[str]:
    """Second `a` becomes `a_1`, third `a_2`."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}_{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def renames(names: list[str]) -> list[tuple[str, str]]:
    """(given, new) of the header names that `deduplicated_names` changes."""
    return [(a, b) for a, b in zip(names, deduplicated_names(names)) if a != b]


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header as given; a name that is missing is made from its place."""
    first = spark.read.options(header=False, sep=sep, quote='"', escape='"', multiLine=True).csv(path).first()
    if first is None:
        raise ValueError("the file holds no rows")
    return [f"Unnamed: {i}" if h is None else str(h) for i, h in enumerate(first)]


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Delimited text with a header. Repeated header names are kept apart by a number. Files are read in splits; where a
    quoted value holds a line break, records are first put together from the lines (`records`). `multiline` reads each file
    in one task instead. A record with more values than the header is an error; missing values at its end are null."""
    options = {"sep": sep, "quote": '"', "escape": '"', "header": True, "inferSchema": True, "enforceSchema": True}
    names = deduplicated_names(header(spark, path, sep))
    if multiline:
        return spark.read.options(multiLine=True, **options).csv(path).toDF(*names)
    text = records.lines(spark, path)
    width = F.max(records.fields(F.col("value"), sep)).alias("width")
    facts = text.agg(F.count_if(records.ends_inside(F.col("value"), sep)).alias("open"), width, *[
        F.count_if(F.contains("value", F.lit(c))).alias(f"c{i}") for i, c in enumerate(records.SEPARATORS)]).first()
    if facts["open"]:
        free = [c for i, c in enumerate(records.SEPARATORS) if not facts[f"c{i}"]]
        if not free:
            raise ValueError("line breaks in quotes beside all of the control characters 1C to 1F: read with multiline=True")
        path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
        records.records(text, sep).write.text(path, lineSep=free[0])
        options |= {"header": False, "lineSep": free[0]}
        facts = spark.read.text(path, lineSep=free[0]).agg(width).first()
    if (facts["width"] or 0) > len(names):
        raise ValueError(f"a record has {facts['width']} values, the header {len(names)}")
    table = spark.read.options(**options).csv(path)
    missing = [F.lit(None).cast("string")] * (len(names) - len(table.columns))  # columns that no record has
    return table.select("*", *missing).toDF(*names)


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One object a line in splits; a file that starts with an array, or with an object over several lines, is read by one
    task. What is neither is an error."""
    if not multiline:
        first = spark.read.text(path).select(F.btrim("value").alias("value")).filter("value <> ''").first()
        multiline = first is not None and not (first["value"].startswith("{") and first["value"].endswith("}"))
    table = spark.read.json(path, multiLine=multiline)
    if "_corrupt_record" in table.columns:
        raise ValueError("the file holds something that isn't a JSON object or an array of them")
    return table


def load(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = False) -> DataFrame:
    """Read a table; the format comes from the extension unless given. JSON is one record a line, as `write` gives it, or an
    array or objects over several lines, a file a task."""
    fmt = (fmt or PurePosixPath(path).suffix.lstrip(".")).lower()
    if fmt == "csv":
        return read_delimited(spark, path, multiline=multiline)
    if fmt == "tsv":
        return read_delimited(spark, path, "\t", multiline)
    if fmt == "json":
        return read_json(spark, path, multiline)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt}")


def validate(df: DataFrame) -> DataFrame:
    """Raise when a table is empty, too small, or holds nothing but nulls. One aggregate decides."""
    clean = C.nan_to_null(df)
    facts = clean.agg(F.count("*").alias("rows"),
                      F.coalesce(F.bool_or(C.any_of([C.col(n).isNotNull() for n in clean.columns])), F.lit(False)).alias("data")
                      ).first()
    if facts["rows"] == 0:
        raise ValueError("the table has 0 rows")
    if len(df.columns) < MIN_COLUMNS:
        raise ValueError(f"the table has {len(df.columns)} columns, at least {MIN_COLUMNS} are needed")
    if facts["rows"] < MIN_ROWS:
        raise ValueError(f"the table has {facts['rows']} rows, at least {MIN_ROWS} are needed")
    if not facts["data"]:
        raise ValueError("all columns are entirely null")
    return df


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip white space from both ends of every string."""
    return df.withColumns({n: C.strip(C.col(n)) for n in C.string_columns(df)})


def tighten_types(df: DataFrame) -> DataFrame:
    """Float columns whose values are all whole become long. One aggregate decides for all of them."""
    floats = [f.name for f in df.schema if C.is_float(f.dataType)]
    if not floats:
        return df
    # Fixed value: doubles are exact whole numbers up to 2^53.
    limit = float(2**53)
    facts = df.agg(*[
        F.coalesce(F.bool_and((F.floor(C.number(df, n)) == C.number(df, n)) & (F.abs(C.number(df, n)) <= limit)),
                   F.lit(False)).alias(f"w{i}") for i, n in enumerate(floats)]).first()
    whole = [n for i, n in enumerate(floats) if facts[f"w{i}"]]
    return df.withColumns({n: C.number(df, n).cast("long") for n in whole})


def prepare(df: DataFrame) -> DataFrame:
    """Validate, tighten types and strip strings, as done after every load."""
    return strip_strings(tighten_types(validate(df)))


def table_meta(df: DataFrame) -> DataFrame:
    """(rows, columns, total_cells)."""
    width = F.lit(len(df.columns)).cast("long")
    return df.agg(F.count("*").alias("rows")).select("rows", width.alias("columns"), (F.col("rows") * width).alias("total_cells"))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table; csv and tsv files carry a header, and `load` gives back the same texts
    (empty ones as null)."""
    writer = df.write.mode(mode)
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    {"parquet": writer.parquet, "json": lambda p: writer.json(p, ignoreNullFields=False), "csv": lambda p: writer.csv(p, **plain),
     "tsv": lambda p: writer.csv(p, sep="\t", **plain)}[fmt](path)
