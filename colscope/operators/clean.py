"""Clean a table: drop columns, remove duplicate rows, normalise categories, fill nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import columns as C
from colscope.functions.quantiles import exact_percentiles
from colscope.functions.staging import staged


@dataclass
class Cleaned:
    df: DataFrame
    report: DataFrame  # one row: sizes, removed duplicates, null counts
    imputed: DataFrame  # (column, strategy, fill)


def columns_to_drop(df: DataFrame, advice: dict[str, dict], choices: dict[str, dict], apply_all: bool = False) -> list[str]:
    """Only columns named in the choices are considered, unless `apply_all` follows the advice everywhere."""
    named = list(advice) + [c for c in choices if c not in advice] if apply_all else list(choices)
    return [c for c in named
            if c in df.columns and choices.get(c, {}).get("drop", advice.get(c, {}).get("drop", False))]


def normalise_categories(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.lower(C.strip(C.col(n))) for n in C.string_columns(df) if classes.get(n) == "categorical"})


def fills(df: DataFrame, strategies: dict[str, str], classes: dict[str, str]) -> dict[str, tuple[str, object]]:
    """{column: (strategy, value)} for the columns with nulls whose strategy applies to their class."""
    if not strategies:
        return {}
    names = list(strategies)
    numeric = [n for n in names if classes.get(n) == "numerical"]
    means = [n for n in numeric if strategies[n] == "mean"]
    medians = [n for n in numeric if strategies[n] == "median"]
    common = [n for n in names if strategies[n] == "mode"]
    out: dict[str, tuple[str, object]] = {}
    if means:
        row = df.agg(*[F.avg(C.number(df, n)).alias(f"m{i}") for i, n in enumerate(means)]).first()
        out.update({n: ("mean", row[f"m{i}"]) for i, n in enumerate(means)})
    if medians:
        found = exact_percentiles(df, {n: C.number(df, n) for n in medians}, [0.5])
        out.update({n: ("median", v[0]) for n, v in found.items()})
    if common:
        for n, value in C.modes(df, common).items():
            flag = isinstance(C.type_of(df, n), T.BooleanType)
            out[n] = ("mode", value == "true" if flag else value)
    return {n: v for n, v in out.items() if v[1] is not None}


def clean(df: DataFrame, profile: DataFrame, advice: DataFrame, choices: dict[str, dict] | None = None,
          apply_all: bool = False) -> Cleaned:
    """Apply the choices, which override the advice column by column.

    `profile` and `advice` have one row per column of the table.
    """
    choices = choices or {}
    facts = {r["column"]: r for r in profile.collect()}
    advised = {r["column"]: r.asDict() for r in advice.collect()}
    classes = {n: r["dtype_class"] for n, r in facts.items()}
    rows_before = max([r["n_rows"] for r in facts.values()], default=0)

    dropped = columns_to_drop(df, advised, choices, apply_all)
    kept = C.nan_to_null(df.drop(*dropped))
    out = staged(normalise_categories(kept.dropDuplicates(), classes))

    counts = out.agg(F.count("*").alias("rows"),
                     *[F.count_if(C.col(n).isNull()).alias(f"n{i}") for i, n in enumerate(out.columns)]).first()
    nulls = {n: counts[f"n{i}"] for i, n in enumerate(out.columns)}
    strategies = {n: choices.get(n, advised.get(n, {})).get("imputation") or "mean" for n in out.columns if nulls[n] > 0}
    filled = fills(out, strategies, classes)
    done = out.withColumns({
        n: F.coalesce(C.col(n), F.lit(v).cast("double" if s in ("mean", "median") else C.type_of(out, n)))
        for n, (s, v) in filled.items()})

    spark = df.sparkSession
    report = spark.createDataFrame(
        [(rows_before, len(df.columns), counts["rows"], len(done.columns), rows_before - counts["rows"],
          sum(facts[n]["null_count"] for n in done.columns if n in facts),
          sum(c for n, c in nulls.items() if n not in filled))],
        "rows_before long, columns_before long, rows_after long, columns_after long, removed_duplicates long, "
        "null_count_before long, null_count_after long")
    imputed = spark.createDataFrame([(n, s, str(v)) for n, (s, v) in filled.items()],
                                    "column string, strategy string, fill string")
    return Cleaned(done, report, imputed)
