import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colscope.operators import quality
from colscope.sources import samples, tables


def test_repeated_headers():
    assert tables.deduplicated_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]


def test_csv_tsv_json_parquet(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,a\n1,"x, ""y""",2.5\n3,"two\nlines",4\n')
    df = tables.load(spark, str(tmp_path / "t.csv"), multiline=True)
    assert df.columns == ["a", "b", "a_1"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'x, "y"', 2.5), (3, "two\nlines", 4.0)]
    (tmp_path / "t.tsv").write_text("p\tq\n1\tu\n")
    assert tables.load(spark, str(tmp_path / "t.tsv")).first().q == "u"
    (tmp_path / "t.json").write_text(json.dumps([{"k": 1, "v": "a"}, {"k": 2, "v": None}]))
    assert tables.load(spark, str(tmp_path / "t.json"), multiline=True).count() == 2
    tables.write(df, str(tmp_path / "out"), "parquet")
    assert tables.load(spark, str(tmp_path / "out"), "parquet").count() == 2
    tables.write(df, str(tmp_path / "outc"), "csv")
    assert tables.load(spark, str(tmp_path / "outc"), "csv", multiline=True).columns == ["a", "b", "a_1"]
    with pytest.raises(ValueError):
        tables.load(spark, "x.doc")


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_round_trip_in_splits(spark, tmp_path, fmt):
    df = spark.range(5000).select("id", F.concat(F.lit("name, "), "id").alias("s"))
    tables.write(df, str(tmp_path / fmt), fmt)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        back = tables.load(spark, str(tmp_path / fmt), fmt)
        assert back.rdd.getNumPartitions() >= 8
        assert {tuple(r) for r in back.select("id", "s").collect()} == {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


AWKWARD = ["two\nlines", "\n", "a\r\nb", 'say "hi"', '"', '""', '"\n"', "tab\there", ",", ",\n,", "", None, " padded ", "5\" pipe", "x\n\ny", "\\", "\\n", "last\n",
           '",\n"', "é\n漢"]


def as_pandas_reads(path, sep=","):
    import pandas as pd

    frame = pd.read_csv(path, sep=sep, keep_default_na=False, dtype=str)
    return [tuple(r) for r in frame.itertuples(index=False)]


@pytest.mark.parametrize("split", ["128m", "48"])
@pytest.mark.parametrize("fmt", ["csv", "tsv", "json"])
def test_line_breaks_survive(spark, tmp_path, fmt, split):
    df = spark.createDataFrame([(i, AWKWARD[i % len(AWKWARD)], f"k{i}") for i in range(40)], "id long, s string, k string").coalesce(1)
    tables.write(df, str(tmp_path / "t"), fmt)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        back = tables.load(spark, str(tmp_path / "t"), fmt)
        wanted = [(r.id, None if fmt != "json" and r.s == "" else r.s, r.k) for r in df.collect()]  # delimited text has no empty strings
        assert Counter(tuple(r) for r in back.select("id", "s", "k").collect()) == Counter(wanted)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [
    'a,b\r\n1,"x\r\ny"\r\n2,z\r\n', 'a,b\n1,5" pipe\n2,"u\nv"\n3,6" pipe\n', 'a,b\n"1","q"\n"2","two\n\n""lines"""\n', 'a,"b\nc"\n1,"2\n3"\n', 'a,b\n1,"x"\n2,"y"',
    'a,b\n1,"x\n,\n"",""\n"\n2,"\n"\n'])
@pytest.mark.parametrize("split", ["128m", "9"])
def test_records_as_another_reader_has_them(spark, tmp_path, text, split):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = tables.load(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter(tuple("" if v is None else str(v) for v in r) for r in found) == Counter(as_pandas_reads(path))


def test_bad_records_and_headers(spark, tmp_path):
    for text in ("a,b\n1,2\n3,4,5\n", 'a,b\n1,"2\n"\n3,4,"5\n"\n'):
        (tmp_path / "t.csv").write_text(text)
        with pytest.raises(ValueError, match="3 values"):
            tables.load(spark, str(tmp_path / "t.csv"))
    (tmp_path / "u.csv").write_text("a,,b,a\n1,2,3\n")
    df = tables.load(spark, str(tmp_path / "u.csv"))
    assert df.columns == ["a", "Unnamed: 1", "b", "a_1"] and tuple(df.first()) == (1, 2, 3, None)
    assert tables.renames(["a", "b", "a"]) == [("a", "a_1")]


def test_json_forms(spark, tmp_path):
    rows = [{"k": 1, "v": "a\nb"}, {"k": 2, "v": None}]
    for name, text in [("array", json.dumps(rows)), ("tall", json.dumps(rows, indent=2)), ("lines", "\n".join(map(json.dumps, rows)) + "\n\n"),
                       ("one", json.dumps(rows[0], indent=1))]:
        (tmp_path / f"{name}.json").write_text(text)
        found = [tuple(r) for r in tables.load(spark, str(tmp_path / f"{name}.json")).orderBy("k").collect()]
        assert found == [(1, "a\nb"), (2, None)][: 1 if name == "one" else 2], name
    (tmp_path / "bad.json").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(ValueError, match="JSON"):
        tables.load(spark, str(tmp_path / "bad.json"))


def test_validation(spark):
    ok = spark.range(10).select("id", F.lit("x").alias("s"))
    assert tables.validate(ok) is ok
    for bad in (ok.limit(0), ok.limit(9), ok.select("id"), ok.select(F.lit(None).cast("int").alias("a"), F.lit(None).cast("string").alias("b"))):
        with pytest.raises(ValueError):
            tables.validate(bad)


def test_tighten_and_strip(spark):
    df = spark.createDataFrame([(1.0, 1.5, "\t a \n"), (None, 2.0, None), (float("nan"), 3.0, "b")], "a double, b double, s string")
    out = tables.prepare(df.union(df).union(df).union(df))
    assert dict(out.dtypes)["a"] == "bigint" and dict(out.dtypes)["b"] == "double"
    assert {r.s for r in out.collect()} == {"a", "b", None}


def test_samples(spark):
    assert samples.sample_table(spark, "passengers").count() == 891
    house = samples.sample_table(spark, "housing")
    assert house.count() == 2040
    assert quality.duplicate_rows(house).first()["count"] == 40
    orders = samples.sample_table(spark, "messy_orders")
    found = {(r["column"], r["issue_type"]) for r in quality.consistency(orders).collect()}
    assert {("product_category", "case_inconsistency"), ("unit_price", "symbol_contamination")} <= found
    with pytest.raises(ValueError):
        samples.sample_table(spark, "nope")
