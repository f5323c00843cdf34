"""Pearson, Spearman and Kendall correlation of all pairs of number columns.

Results are long tables (method, col_a, col_b, r), a before b in column order. Nulls are left out
pair by pair.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.lookups import looked_up
from colscope.functions.running import average_ranks, running_totals
from colscope.functions.staging import staged

MIN_COLUMNS = 3
PAIRS_PER_AGGREGATE = 500


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[C.number(df, n).alias(n) for n in names])


def _pair(method: str, a: str, b: str, r: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r"))


def _correlate(method: str, df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """`corr` of each pair in one aggregate per few hundred pairs; it skips rows with a null on either side."""
    chunks = [pairs[i : i + PAIRS_PER_AGGREGATE] for i in range(0, len(pairs), PAIRS_PER_AGGREGATE)]
    parts = [C.tidy(df, [_pair(method, a, b, F.corr(C.col(a), C.col(b))) for a, b in chunk]) for chunk in chunks]
    return reduce(DataFrame.unionAll, parts)


def pearson(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names if names is not None else C.numeric_columns(df)
    return _correlate("pearson", _numbers(df, names), list(combinations(names, 2)))


def with_ranks(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace each column by its average ranks. Ranks come from the value counts and are looked up, frequent values apart."""
    ranks = staged(average_ranks(C.number_counts(df, names), by=["column"]))
    out = df
    for i, n in enumerate(names):
        out = looked_up(out, ranks.filter(F.col("column") == n), {"value": C.col(n)}, "rank", f"_r{i}")
    return out.select(*[F.col(f"_r{i}").alias(n) for i, n in enumerate(names)])


def spearman(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Columns without nulls are ranked once; the pairs with nulls are ranked within their complete rows, all of them in one
    table of (pair, side, value)."""
    names = names if names is not None else C.numeric_columns(df)
    x = _numbers(df, names)
    filled = x.agg(F.count("*").alias("rows"), *[F.count(C.col(n)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    full = [n for i, n in enumerate(names) if filled[f"c{i}"] == filled["rows"]]
    parts = []
    if len(full) >= 2:
        parts.append(_correlate("spearman", with_ranks(x.select(*map(C.col, full)), full), list(combinations(full, 2))))
    rest = [(a, b) for a, b in combinations(names, 2) if a not in full or b not in full]
    if rest:
        parts.append(_spearman_with_nulls(x, rest))
    return reduce(DataFrame.unionAll, parts)


def _spearman_with_nulls(x: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("pair"), C.col(a).alias("a"), C.col(b).alias("b")) for i, (a, b) in enumerate(pairs)]
    rows = staged(x.select(F.inline(F.array(*entries))).dropna())
    sides = rows.select("pair", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("value")), F.struct(F.lit(1).alias("side"), F.col("b").alias("value")))))
    counts = sides.groupBy("pair", "side", "value").agg(F.count("*").alias("n"))
    ranks = staged(average_ranks(counts, by=["pair", "side"]))
    for side, column in enumerate("ab"):
        rows = looked_up(rows, ranks.filter(F.col("side") == side), {"pair": F.col("pair"), "value": F.col(column)}, "rank", f"rank_{column}")
    found = rows.groupBy("pair").agg(F.corr("rank_a", "rank_b").alias("r"))
    every = x.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, col_a string, col_b string")
    return every.join(found, "pair", "left").select(F.lit("spearman").alias("method"), "col_a", "col_b", "r")


def kendall(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Tau-b of each pair."""
    names = names if names is not None else C.numeric_columns(df)
    x = _numbers(df, names)
    sizes = x.agg(*[F.approx_count_distinct(C.col(n)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    size = {n: sizes[f"c{i}"] for i, n in enumerate(names)}
    pairs = list(combinations(names, 2))
    joints = []
    for i, (a, b) in enumerate(pairs):
        coarse, fine = sorted([a, b], key=lambda n: size[n])
        joints.append(
            x.select(C.col(fine).alias("x"), C.col(coarse).alias("y")).dropna()
            .groupBy("x", "y").agg(F.count("*").alias("n")).select(F.lit(i).alias("pair"), "x", "y", "n")
        )
    tau = _tau_b(staged(reduce(DataFrame.unionAll, joints)))
    left = F.array(*[F.lit(a) for a, _ in pairs])[F.col("pair")]
    right = F.array(*[F.lit(b) for _, b in pairs])[F.col("pair")]
    return tau.select(F.lit("kendall").alias("method"), left.alias("col_a"), right.alias("col_b"), "r")


def _tau_b(joint: DataFrame) -> DataFrame:
    """Tau-b per pair of a joint count table (pair, x, y, n), without comparing cells pairwise.

    y is numbered densely. Two cells with different numbers first differ, from the top, in one binary
    digit, and share the digits above it. So for every digit, among cells with equal higher digits, the
    cells with 0 and 1 in it are counted along x: a 1 after a 0 is concordant, a 0 after a 1 discordant.
    A cell takes part once per digit, log2(distinct y) times in all.
    """
    by_y = joint.groupBy("pair", "y").agg(F.sum("n").alias("n"))
    codes = running_totals(by_y.withColumn("one", F.lit(1)), "y", {"code": "one"}, ["pair"])
    digits = codes.select(
        "pair", "y", "code",
        F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("code_all") - 1)) - 1)).alias("digit"))
    split = joint.join(digits, ["pair", "y"]).select(
        "pair", "x", "n", "digit",
        F.expr("shiftright(code, digit + 1)").alias("above"),
        F.expr("shiftright(code, digit) & 1").alias("bit"),
    )
    per_x = split.groupBy("pair", "digit", "above", "x").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("ones"),
    )
    along = running_totals(per_x, "x", {"zeros_before": "zeros", "ones_before": "ones"},
                           ["pair", "digit", "above"], bounds_by=["pair"])
    ordered = along.groupBy("pair").agg(
        F.sum(F.col("ones") * F.col("zeros_before") - F.col("zeros") * F.col("ones_before")).alias("net"))

    def tied(rows: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("double")
        return rows.groupBy("pair").agg(F.sum(n * (n - 1) / 2).alias(name), F.sum(n).alias(f"{name}_rows"))

    both = F.col("ty_rows") * (F.col("ty_rows") - 1) / 2
    return (
        ordered.join(tied(joint.groupBy("pair", "x").agg(F.sum("n").alias("n")), "tx"), "pair")
        .join(tied(by_y, "ty"), "pair")
        .select("pair", F.try_divide(F.col("net"), F.sqrt(both - F.col("tx")) * F.sqrt(both - F.col("ty"))).alias("r"))
    )


def correlations(df: DataFrame, methods: tuple[str, ...] = ("pearson", "spearman", "kendall")) -> DataFrame:
    """All matrices in long form; empty with fewer than three number columns. Constant columns are left out."""
    names = C.numeric_columns(df)
    if len(names) >= MIN_COLUMNS:
        spread = df.agg(*[F.stddev_samp(C.number(df, n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
        varying = [n for i, n in enumerate(names) if spread[f"s{i}"] and spread[f"s{i}"] > 0]
    else:
        varying = []
    if len(varying) < 2:
        return df.sparkSession.createDataFrame([], "method string, col_a string, col_b string, r double")
    each = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
    return reduce(DataFrame.unionAll, [each[m](df, varying) for m in methods])


def high_pairs(matrix: DataFrame, threshold: float = 0.8, drop_above: float = 0.95) -> DataFrame:
    """(col_a, col_b, pearson_r, advice) of the pairs above the threshold, strongest first."""
    size = F.abs("r")
    return (
        matrix.filter((F.col("method") == "pearson") & (size > threshold))
        .select("col_a", "col_b", C.round_to("r", 4).alias("pearson_r"),
                F.when(size > drop_above, "drop one").otherwise("investigate").alias("advice"))
        .orderBy(F.desc(F.abs("pearson_r")), "col_a", "col_b")
    )


def by_target_correlation(matrix: DataFrame, target: str) -> DataFrame:
    """(column, abs_r) of the other columns by strength of their correlation with the target."""
    other = F.when(F.col("col_a") == target, F.col("col_b")).when(F.col("col_b") == target, F.col("col_a"))
    return (
        matrix.select(other.alias("column"), F.abs(C.round_to("r", 4)).alias("abs_r"))
        .dropna().orderBy(F.desc("abs_r"), "column")
    )
