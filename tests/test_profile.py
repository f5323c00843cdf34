import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions import staging
from colscope.operators import clean, dates, outliers, profile, quality, sampling, score, stats, text, typing
from colscope.plans import analysis


def classes(df):
    return {r["column"]: r["dtype_class"] for r in typing.column_types(df).collect()}


def test_type_classes(spark):
    df = spark.range(100).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("bit"), (F.col("id") % 2).cast("string").alias("bit_text"),
        F.when(F.col("id") % 2 == 0, "Yes").otherwise(" no").alias("yes_no"),
        F.when(F.col("id") % 4 == 0, "male").when(F.col("id") % 4 == 1, "Male").otherwise("female").alias("sex"),
        (F.col("id") / 7).alias("x"), F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))).alias("mixed"),
        F.repeat(F.lit("word "), 20).alias("text"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")), "MM/dd/yyyy").alias("day"),
        F.col("id").cast("boolean").alias("flag"), F.lit(True).alias("always"),
        F.when(F.col("id") % 2 == 0, F.col("id") / 3).otherwise(float("nan")).alias("with_nan"))
    assert classes(df) == {
        "id": "identifier", "bit": "boolean", "bit_text": "categorical", "yes_no": "boolean", "sex": "categorical", "x": "numerical",
        "flat": "numerical", "empty": "categorical", "mixed": "mixed", "text": "text", "day": "datetime", "flag": "boolean",
        "always": "numerical", "with_nan": "numerical"}
    row = profile.profile_columns(df).filter("column = 'with_nan'").first()
    assert (row.null_count, row.unique_count) == (50, 50)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(i, float(i % 3), "a" if i % 2 else "b") for i in range(20)], "`a.b` long, `c d` double, `e``f` string")
    assert profile.profile_columns(df).count() == 3
    assert stats.numeric_summary(df, ["a.b", "c d"]).count() == 2
    assert quality.missing_values(df).count() == 0


def test_empty_and_single_row(spark):
    for rows in ([], [(1, 2.0, "a")]):
        df = spark.createDataFrame(rows, "a int, b double, s string")
        assert profile.profile_columns(df).count() == 3
        assert stats.numeric_summary(df).count() == 0
        assert quality.duplicate_rows(df).first()["count"] == 0
        assert outliers.outlier_table(df).filter("iqr_outliers > 0").count() == 0
        assert quality.consistency(df).count() == 0


def test_missing_and_severity(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 3, F.col("id")).alias("low"), F.when(F.col("id") >= 40, F.col("id")).alias("high"),
        F.when(F.col("id") >= 85, F.col("id")).alias("critical"), F.col("id").alias("full"))
    found = {r["column"]: (r["count"], r["severity"]) for r in quality.missing_values(df).collect()}
    assert found == {"low": (3, "low"), "high": (40, "high"), "critical": (85, "critical")}


def test_duplicates_and_case(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "a int, b string")
    row = quality.duplicate_rows(df).first()
    assert (row["count"], row["pct"]) == (1, 0.3333)
    long = "z" * 500
    assert quality.duplicate_rows(spark.createDataFrame([(long,), (long,), (long + "!",)], "t string")).first()["count"] == 1
    sexes = spark.createDataFrame([(s,) for s in ["Male", "male", "Female", "FEMALE", "Male", "male"]], "col string")
    assert [tuple(r) for r in quality.case_inconsistency(sexes).collect()] == [("col", 2)]
    twins = spark.createDataFrame([(1, 1, None, None), (2, 2, 3.0, 3.0)], "a int, b int, c double, d double")
    assert {tuple(r) for r in quality.duplicate_columns(twins).collect()} == {("a", "b"), ("c", "d")}


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(s,) for s in ["1", " 2.5 ", "1e3", "1d", "NaN", "inf", "x", "", ".5", "5."]], "s string")
    got = [r[0] for r in df.select(C.as_number(F.col("s"))).collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, math.inf, None, None, 0.5, 5.0]


def test_modes_and_ties(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (1.0,), (1.0,), (9.0,)], "x double")
    row = stats.numeric_summary(df).first()
    assert (row.mode, row.median, row.mean, row.q1, row.q3) == (1.0, 3.0, 3.4, 1.0, 3.0)
    flat = stats.numeric_summary(spark.createDataFrame([(2.0,)] * 5, "x double")).first()
    assert (flat.std, flat.cv, flat.skewness, flat.distribution_shape) == (0.0, 0.0, None, "unknown")


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,)], "x double")
    row = outliers.outlier_table(df).first()
    assert (row.iqr_outliers, row.zscore_outliers) == (1, 1)
    assert [r.value for r in outliers.outlier_examples(df).collect()] == [1000.0]


def test_isolation_forest_flags_the_far_ones(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 40, 100 + F.rand(1)).otherwise(F.randn(2)).alias("x"))
    flagged = outliers.isolation_forest(df).first()[1]
    assert 40 <= flagged <= 100
    assert outliers.isolation_forest(df.limit(100)).count() == 0


def test_forest_and_folds_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") % 977).alias("x"), (F.col("id") % 7).alias("y"))
    forests = [sorted(map(tuple, outliers.isolation_forest(df.repartition(n), ["x"]).collect())) for n in (1, 8)]
    assert forests[0] == forests[1] and len(forests[0]) == 1
    folds = [sorted(map(tuple, sampling.with_folds(df.repartition(n), 3).collect())) for n in (1, 8)]
    assert folds[0] == folds[1] and len(folds[0]) == 3000


def test_bucketed_tables_are_removed(spark):
    def names():
        return {t.name for t in spark.catalog.listTables()}

    before, there = staging.tables(), names()
    made = staging.bucketed(spark.range(100).withColumn("part", F.col("id") % 2 == 0), "id", "part")
    assert made.count() == 100 and len(names() - there) == 1
    staging.discard(made)
    assert staging.tables() == before and names() == there


def test_health(spark):
    def health(null_pct, outlier_pct, dup_pct, pairs, ratio=None, known=False):
        row = spark.createDataFrame([(null_pct, outlier_pct, dup_pct, ratio, known, pairs)],
                                    "null_pct double, outlier_pct double, dup_pct double, imbalance_ratio double, has_target_stats boolean, high_pairs long")
        return score.health_from_rates(row).first()

    clean_ = health(0.0, 0.0, 0.0, 0)
    assert clean_.grade == "A" and clean_.total == 96.0
    worst = health(1.0, 1.0, 1.0, 20)
    assert (worst.total, worst.grade, worst.worst_dimension) == (16.0, "D", "Missing Values")
    assert health(0.3, 0.0, 0.0, 0).total < clean_.total
    assert health(0.0, 0.0, 0.0, 0, 11.0, True).class_balance_score == 0.0
    assert health(0.0, 0.0, 0.0, 0, None, True).class_balance_score == 100.0


def test_readiness(spark):
    df = spark.createDataFrame([(i, None if i % 4 else 1.0) for i in range(40)], "id long, t double")
    codes = {(r.kind, r.code) for r in score.readiness(profile.profile_columns(df), "t").collect()}
    assert codes == {("blocker", "too_few_rows"), ("blocker", "target_mostly_null"), ("blocker", "only_identifiers"),
                     ("blocker", "too_few_features"), ("warning", "many_sparse_columns")}


def test_date_rules(spark):
    df = spark.createDataFrame([("2024-01-01 00:30:00", "01/31/2024", "31/01/2024"), ("2024-01-03 00:10:00", "02/01/2024", "01/02/2024")],
                               "a string, b string, c string").withColumn("n", F.col("a").cast("timestamp_ntz"))
    rows = {r["column"]: r for r in dates.date_summary(df).collect()}
    assert set(rows) == {"a", "b", "c", "n"}
    assert rows["n"].range_days == 1 and rows["n"].has_time_component is False
    assert rows["b"].min_date == "2024-01-31" and rows["b"].max_date == "2024-02-01"
    assert rows["c"].min_date == "2024-01-31" and rows["c"].max_date == "2024-02-01"
    assert "n_hour" not in dates.add_date_parts(df, "n").columns


def test_words(spark):
    df = spark.createDataFrame([("The café sold red apples, RED apples!",), ("élan vital red apples",)], "t string")
    counts = {r.value: r.n for r in text.word_counts(df, ["t"]).collect()}
    assert counts == {"sold": 1, "red": 3, "apples": 3, "vital": 1}
    grams = {r.value: r.n for r in text.ngram_counts(df, ["t"], 2).collect()}
    assert grams == {"sold red": 1, "red apples": 3, "apples red": 1, "vital red": 1}


def test_ngrams_across_rows(spark):
    rows = ["one two", "", "three", "four", "five six seven eight", "the", "nine ten"]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, t string")
    flat = [w for r in rows for w in r.split() if len(w) >= 3 and w not in text.STOPWORDS]
    for n in (2, 3):
        expected = {}
        for i in range(len(flat) - n + 1):
            g = " ".join(flat[i : i + n])
            expected[g] = expected.get(g, 0) + 1
        assert {r.value: r.n for r in text.ngram_counts(df, ["t"], n, across_rows="k").collect()} == expected


def test_ngrams_across_rows_read_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def given(k):
        read.add(1)
        return None if k % 7 == 3 else " ".join(f"word{'abcdefgh'[(k + i) % 8] * 2}" for i in range(k % 9))

    df = spark.range(60).select(F.col("id").alias("k"), F.udf(given, "string")("id").alias("t"))
    flat = [w for k in range(60) if k % 7 != 3 for w in [f"word{'abcdefgh'[(k + i) % 8] * 2}" for i in range(k % 9)]]
    for n in (1, 2, 4):
        read.value = 0
        expected = Counter(" ".join(flat[i : i + n]) for i in range(len(flat) - n + 1))
        assert {r.value: r.n for r in text.ngram_counts(df, ["t"], n, across_rows="k").collect()} == expected
        assert read.value == 60


def test_cleaning_choices(spark):
    df = spark.createDataFrame(
        [("A", 1.0, 1), (" a", None, 2), ("A", 1.0, 1), ("b", 5.0, 3)] + [("b", None, i) for i in range(4, 30)], "c string, x double, k int")
    p = profile.profile_columns(df)
    advice = score.preprocessing(p, stats.numeric_summary(df))
    kept = clean.clean(df, p, advice, {"x": {"drop": False, "imputation": "median"}})
    assert kept.df.columns == ["c", "x", "k"]
    report = kept.report.first()
    assert (report.rows_before, report.rows_after, report.removed_duplicates, report.null_count_after) == (30, 29, 1, 0)
    assert {r.x for r in kept.df.collect()} == {1.0, 3.0, 5.0}
    everything = clean.clean(df, p, advice, apply_all=True)
    assert "k" not in everything.df.columns and "x" not in everything.df.columns


def test_analysis(spark, tmp_path):
    df = spark.range(300).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"),
                                 F.when(F.rand(4) < 0.3, "x").otherwise("y").alias("outcome"))
    p = analysis.analyse(df, target="auto", forest=False)
    assert p.target == "outcome"
    assert p.correlations.count() == 18
    assert p.problem.first().problem_type == "classification"
    p.write(str(tmp_path / "profile"))
    assert spark.read.json(str(tmp_path / "profile" / "columns")).count() == 5
    c = analysis.compare_tables(df, df.withColumn("a", F.col("a") + 1))
    assert {r["column"] for r in c.shifts.filter("shift_detected").collect()} == {"a"}
    assert c.summary.first().n_distribution_shifts == 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitioning_changes_nothing(spark, partitions):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("s"))
    mixed = df.repartition(partitions).orderBy(F.xxhash64("id"))
    for op in (profile.profile_columns, stats.numeric_summary, quality.missing_values, outliers.outlier_table):
        assert sorted(map(str, op(df).collect())) == sorted(map(str, op(mixed).collect()))


def test_advice_needs_no_modes(spark, monkeypatch):
    """Suggestions and advice take the skewness alone, the same as that of the numeric summary."""
    from colscope.operators import stats
    from colscope.plans import score_queries

    df = spark.createDataFrame([(float(i), 1.0 if i else 500.0, None, "x") for i in range(30)], "a double, age double, none double, s string")
    whole = {tuple(r) for r in stats.numeric_summary(df).select("column", "skewness").collect()}
    assert {tuple(r) for r in stats.skewness(df).collect()} == whole and len(whole) == 2
    monkeypatch.setattr(stats, "numeric_summary", None)
    assert {(r.column, r.rule_name) for r in score_queries._suggestions(df).collect()} >= {("age", "log_transform")}
    assert {r.column: r.imputation for r in score_queries._advice(df)[1].collect()}["age"] == "median"
