"""Turn a cleaned table into a feature vector: impute, scale, encode, assemble.

What is learned is a handful of numbers per column, and a table of levels with their codes, which is never collected: codes
are places in a distributed order, and rows find theirs by joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import columns as C
from colscope.functions.lookups import looked_up
from colscope.functions.quantiles import exact_percentiles
from colscope.functions.running import positions
from colscope.functions.staging import staged

FEW_LEVELS = 20_000  # levels of a column, by keys of 65 characters at most, that are broadcast as a whole
DENSE = 256  # slots up to which a vector holds its zeros


def choose_columns(columns: list[str], classes: dict[str, str], advice: dict[str, dict] | None = None,
                   choices: dict[str, dict] | None = None, target: str | None = None) -> dict[str, list[str]]:
    """Columns by treatment: standard, robust, minmax, one_hot, ordinal.

    The target, dropped columns and the classes text, datetime, identifier and mixed are left out.
    """
    groups: dict[str, list[str]] = {"standard": [], "robust": [], "minmax": [], "one_hot": [], "ordinal": []}
    for n in columns:
        plan = (choices or {}).get(n, (advice or {}).get(n, {}))
        if n == target or plan.get("drop"):
            continue
        if classes.get(n) == "numerical":
            scaling = plan.get("scaling")
            groups[scaling if scaling in ("robust", "minmax") else "standard"].append(n)
        elif classes.get(n) in ("categorical", "boolean"):
            groups["ordinal" if plan.get("encoding") in ("ordinal", "frequency") else "one_hot"].append(n)
    return groups


def scaling_facts(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, tuple[float, float, float]]:
    """{column: (fill, shift, scale)} so that a value becomes (coalesce(x, fill) - shift) / scale."""
    plain = groups["standard"] + groups["minmax"]
    out: dict[str, tuple[float, float, float]] = {}
    if plain:
        stats = df.agg(*[
            F.struct(F.avg(C.number(df, n)), F.count(C.number(df, n)) / F.count("*"), F.var_pop(C.number(df, n)),
                     F.min(C.number(df, n)), F.max(C.number(df, n))).alias(f"s{i}") for i, n in enumerate(plain)]).first()
        for i, n in enumerate(plain):
            mean, filled, variance, low, high = stats[f"s{i}"]
            if mean is None:
                continue
            if n in groups["standard"]:
                # Mean-filled rows add nothing to the squares but count among the rows.
                out[n] = (mean, mean, (variance * filled) ** 0.5 or 1.0)
            else:
                out[n] = (mean, low, (high - low) or 1.0)
    if groups["robust"]:
        medians = exact_percentiles(df, {n: C.number(df, n) for n in groups["robust"]}, [0.5])
        whole = {n: F.coalesce(C.number(df, n), F.lit(v[0])) for n, v in medians.items() if v[0] is not None}
        spread = exact_percentiles(df, whole, [0.25, 0.5, 0.75])
        for n, (q1, q2, q3) in spread.items():
            out[n] = (medians[n][0], q2, (q3 - q1) or 1.0)
    return out


@dataclass
class Preprocessor:
    """What was learned: numbers a column, and the levels of the categories as a table (column, level, code, n), which stays
    a table however many there are. A vector has the numbers first, then a slot for each level of the one-hot columns,
    then a code for each of the others."""

    scales: dict[str, tuple[float, float, float]]
    modes: dict[str, str]
    hot: list[str]
    ordered: list[str]
    sizes: dict[str, int]
    levels: DataFrame | None
    output: str = "features"

    @property
    def first(self) -> dict[str, int]:
        """The first slot of each column."""
        at, out = 0, {}
        for n in [*self.scales, *self.hot, *self.ordered]:
            out[n] = at
            at += self.sizes[n] if n in self.hot else 1
        return out

    @property
    def size(self) -> int:
        return len(self.scales) + sum(self.sizes[n] for n in self.hot) + len(self.ordered)

    def names(self, slots: list[int] | None = None) -> list[str]:
        """Names of slots, all unless given: the column, with the level for one-hot slots. Only their levels are looked up."""
        wanted = list(range(self.size)) if slots is None else slots
        of, asked = {}, []
        for n, at in self.first.items():
            wide = self.sizes[n] if n in self.hot else 1
            for slot in [s for s in wanted if at <= s < at + wide]:
                of[slot] = n
                asked += [(n, slot - at)] if n in self.hot else []
        if asked:
            spark = self.levels.sparkSession
            keys = spark.createDataFrame(asked, "column string, code long")
            found = {(r["column"], r["code"]): r["level"] for r in self.levels.join(F.broadcast(keys), ["column", "code"]).collect()}
            of |= {self.first[n] + code: f"{n}_{found[n, code]}" for n, code in asked}
        return [of[s] for s in wanted]


def fit_preprocessor(df: DataFrame, groups: dict[str, list[str]], output: str = "features") -> Preprocessor:
    """Fit on `df` alone; unknown levels later give zeros when one-hot coded and -1 when ordinal."""
    scales = scaling_facts(df, groups)
    numeric = {n: scales[n] for g in ("standard", "robust", "minmax") for n in groups[g] if n in scales}
    categories = groups["one_hot"] + groups["ordinal"]
    modes, sizes, levels = {}, {}, None
    if categories:
        counts = staged(C.value_counts(df, categories))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
        for r in counts.groupBy("column").agg(best.alias("best"), F.count("*").alias("levels")).collect():  # a row a column
            modes[r["column"]], sizes[r["column"]] = r["best"]["value"], r["levels"]
        levels = staged(positions(counts, ["column"], ["value"], "code").select("column", F.col("value").alias("level"), "code", "n"))
    hot, ordered = [n for n in groups["one_hot"] if n in modes], [n for n in groups["ordinal"] if n in modes]
    if not numeric and not modes:
        raise ValueError("no usable feature columns")
    return Preprocessor(numeric, modes, hot, ordered, sizes, levels, output)


def _coded(pre: Preprocessor, df: DataFrame, name: str, out: str) -> DataFrame:
    """Add the code of a column's level, null for an unknown one. Few levels are broadcast as a
    whole, of many the frequent ones."""
    level = F.coalesce(C.col(name).cast("string"), F.lit(pre.modes[name]))
    table = pre.levels.filter(F.col("column") == name).select(C.text_key(F.col("level")).alias("_level"), F.col("code").alias("_code"), "n")
    if pre.sizes[name] <= FEW_LEVELS:
        found = df.withColumn("_key", C.text_key(level)).join(F.broadcast(table.drop("n")), F.col("_key") == F.col("_level"), "left")
        return found.withColumn(out, F.col("_code")).drop("_key", "_level", "_code")
    return looked_up(df, table, {"_level": C.text_key(level)}, "_code", out)


def apply_preprocessor(pre: Preprocessor, df: DataFrame) -> DataFrame:
    """Add the feature vector and nothing else."""
    out, codes = df, {}
    for i, n in enumerate([*pre.hot, *pre.ordered]):
        codes[n] = f"_code {i} of a level"
        out = _coded(pre, out, n, codes[n])
    numbers = []
    for n, (fill, shift, scale) in pre.scales.items():
        x = C.col(n).cast("double")
        numbers.append((F.coalesce(F.when(~F.isnan(x), x), F.lit(float(fill))) - F.lit(float(shift))) / F.lit(float(scale)))
    if pre.size <= DENSE:  # plain expressions, as maps and lambdas are many times slower a row
        hot = [F.when(F.col(codes[n]) == i, 1.0).otherwise(0.0) for n in pre.hot for i in range(pre.sizes[n])]
        ordered = [F.coalesce(F.col(codes[n]), F.lit(-1)).cast("double") for n in pre.ordered]
        vector = array_to_vector(F.array(*numbers, *hot, *ordered))
    else:  # the JSON reader is what makes sparse vectors out of columns
        slots = [F.struct(F.lit(i).cast("int").alias("i"), v.alias("x")) for i, v in enumerate(numbers)]
        for n in pre.hot:
            slots.append(F.struct((F.col(codes[n]) + pre.first[n]).cast("int").alias("i"), F.lit(1.0).alias("x")))
        for n in pre.ordered:
            slots.append(F.struct(F.lit(pre.first[n]).cast("int").alias("i"), F.coalesce(F.col(codes[n]), F.lit(-1)).cast("double").alias("x")))
        filled = F.filter(F.array(*slots), lambda s: s["i"].isNotNull())
        text = lambda field: F.array_join(F.transform(filled, lambda s: s[field].cast("string")), ",")
        record = F.format_string(f'{{"v":{{"type":0,"size":{pre.size},"indices":[%s],"values":[%s]}}}}', text("i"), text("x"))
        vector = F.from_json(record, T.StructType([T.StructField("v", VectorUDT())]))["v"]
    return out.withColumn(pre.output, vector).drop(*codes.values())


def as_columns(pre: Preprocessor) -> list[Column]:
    """The vector's slots as double columns named by feature."""
    array = vector_to_array(F.col(pre.output))
    return [F.get(array, F.lit(i)).alias(n) for i, n in enumerate(pre.names())]


def save(pre: Preprocessor, path: str) -> None:
    facts = {"scales": {n: [float(x) for x in v] for n, v in pre.scales.items()}, "modes": pre.modes, "hot": pre.hot, "ordered": pre.ordered,
             "sizes": pre.sizes, "output": pre.output}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").json(f"{path}/facts")
    if pre.levels is not None:
        pre.levels.write.mode("overwrite").parquet(f"{path}/levels")


def load(spark: SparkSession, path: str) -> Preprocessor:
    facts = json.loads(spark.read.json(f"{path}/facts").first()["facts"])
    levels = spark.read.parquet(f"{path}/levels") if facts["modes"] else None
    return Preprocessor(**{**facts, "scales": {n: tuple(v) for n, v in facts["scales"].items()}}, levels=levels)
