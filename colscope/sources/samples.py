"""Three seeded example tables with the blemishes the operators look for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42


def _pick(values: list[str], seed: int) -> Column:
    return F.get(F.lit(values), F.floor(F.rand(seed) * len(values)).cast("int"))


def _null_share(c: Column, share: float, seed: int) -> Column:
    return F.when(F.rand(seed) >= share, c)


def passengers(spark: SparkSession, rows: int = 891) -> DataFrame:
    """Four spellings of two sexes; nulls in age, fare, cabin and port."""
    i = F.col("id").cast("int")
    return spark.range(rows).select(
        (i + 1).alias("PassengerId"), (F.rand(1) < 0.38).cast("int").alias("Survived"),
        (F.floor(F.rand(2) * 3) + 1).cast("int").alias("Pclass"), F.concat(F.lit("Passenger "), i + 1).alias("Name"),
        _pick(["male", "female", "Male", "FEMALE"], 3).alias("Sex"),
        _null_share(F.abs(F.round(30 + 14 * F.randn(4), 1)), 0.2, 5).alias("Age"),
        F.floor(F.rand(6) * 5).cast("int").alias("SibSp"), F.floor(F.rand(7) * 4).cast("int").alias("Parch"),
        F.concat(F.lit("T"), F.floor(F.rand(8) * 90000 + 10000).cast("int")).alias("Ticket"),
        _null_share(F.round(F.exp(3 + F.randn(9)), 2), 0.05, 10).alias("Fare"),
        _null_share(F.concat(_pick(["A", "B", "C"], 11), F.floor(F.rand(12) * 100).cast("int")), 0.77, 13).alias("Cabin"),
        _null_share(_pick(["S", "C", "Q"], 14), 0.02, 15).alias("Embarked"))


def housing(spark: SparkSession, rows: int = 2000, repeated: int = 40) -> DataFrame:
    """Right-skewed counts, a few null bedrooms, and some rows twice."""
    rooms = F.exp(7.5 + 0.7 * F.randn(4))
    base = spark.range(rows).select(
        "id", F.round(-124 + 10 * F.rand(1), 2).alias("longitude"), F.round(32 + 10 * F.rand(2), 2).alias("latitude"),
        (F.floor(F.rand(3) * 52) + 1).cast("int").alias("housing_median_age"), rooms.cast("int").alias("total_rooms"),
        _null_share(F.floor(rooms * 0.2).cast("double"), 0.01, 5).alias("total_bedrooms"),
        F.exp(7 + 0.7 * F.randn(6)).cast("int").alias("population"), F.exp(6 + 0.6 * F.randn(7)).cast("int").alias("households"),
        F.round(F.exp(1.2 + 0.5 * F.randn(8)), 4).alias("median_income"),
        _pick(["INLAND", "NEAR BAY", "NEAR OCEAN", "<1H OCEAN"], 9).alias("ocean_proximity"),
        F.exp(12 + 0.5 * F.randn(10)).cast("int").alias("median_house_value"))
    return base.unionByName(base.filter(F.col("id") < repeated)).drop("id")


def messy_orders(spark: SparkSession, rows: int = 1500) -> DataFrame:
    """Dates as text, some prices with a currency sign, many nulls."""
    i = F.col("id").cast("int")
    price = F.format_string("%.2f", F.exp(3.5 + 0.8 * F.randn(1)))
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(F.rand(2) * 700).cast("int"))
    return spark.range(rows).select(
        (i + 1000).alias("order_id"), F.date_format(day, "yyyy-MM-dd").alias("order_date"),
        (F.floor(F.rand(3) * 400) + 1).cast("int").alias("customer_id"),
        F.concat(F.lit("Customer "), F.floor(F.rand(4) * 400).cast("int")).alias("customer_name"),
        _pick(["Books", "books", "Garden", "Toys", "TOYS"], 5).alias("product_category"),
        F.concat(F.lit("Product "), F.floor(F.rand(6) * 60).cast("int")).alias("product_name"),
        (F.floor(F.rand(7) * 9) + 1).cast("int").alias("quantity"),
        F.when(F.rand(8) < 0.03, F.concat(F.lit("$"), price)).otherwise(price).alias("unit_price"),
        _null_share(F.round(F.rand(9) * 0.5, 2), 0.15, 10).alias("discount_pct"),
        _pick(["DE", "FR", "US", "us"], 11).alias("shipping_country"), _pick(["card", "cash", "transfer"], 12).alias("payment_method"),
        _pick(["open", "sent", "done"], 13).alias("order_status"),
        _null_share(F.floor(F.rand(14) * 5) + 1.0, 0.3, 15).alias("review_score"), (F.rand(16) < 0.08).cast("int").alias("return_flag"),
        _null_share(F.concat(F.lit("note "), i), 0.7, 17).alias("notes"))


SAMPLES = {"passengers": passengers, "housing": housing, "messy_orders": messy_orders}


def sample_table(spark: SparkSession, name: str) -> DataFrame:
    if name not in SAMPLES:
        raise ValueError(f"unknown sample {name}, choose from {list(SAMPLES)}")
    return SAMPLES[name](spark)
