"""Queries over the column profile, quality, statistics and outliers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.staging import shared_folder
from colscope.operators import outliers, profile, quality, sampling, score, stats, typing
from colscope.plans.registry import query, r, rounded
from colscope.sources import tables as source

NUMBER = r"(?i)^\s*[+-]?(((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?)|inf|infinity)\s*$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?$"

ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
          ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
DOCUMENTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
EVENTS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
          ("value", "double"), ("props", "string")]
LABELLED = [("doc_id", "bigint"), ("lang", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]
LABELLED_SQL = "(select doc_id, lang, n_chars, quality, toxic from documents left join labels using (doc_id))"

NUMERIC = ("bigint", "int", "double")


def labelled(t):
    """Documents with their labels, null where a document has none."""
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")


def moments_sql(x: str, source_sql: str) -> str:
    """Population skewness and excess kurtosis by hand; SQL engines differ in their built-ins."""
    return (f"(select avg(pow(d, 3)) / nullif(pow(avg(d * d), 1.5), 0) as skew, "
            f"avg(pow(d, 4)) / nullif(pow(avg(d * d), 2), 0) - 3 as kurt "
            f"from (select {x}::double - (select avg({x}) from {source_sql}) as d from {source_sql}))")


def profile_sql(source_sql: str, schema) -> str:
    parts = []
    last = len(schema) - 1
    for i, (c, t) in enumerate(schema):
        text, number = t == "string", t in NUMERIC
        skew = f"(select skew from {moments_sql(c, source_sql)})" if number else "null::double"
        word = f"lower(trim({c}))"
        parts.append(f"""
        select '{c}' as "column", {i}::bigint as position, '{t}' as dtype_raw, {int(text)} as is_text,
          {int(number)} as is_number, {int(t in ('bigint', 'int'))} as is_integer, {int(t == 'timestamp_ntz')} as is_date,
          count(*) as n_rows, count({c}) as filled, count(distinct {c}) as uniq,
          {f"avg(length({c}))" if text else "null"} as len,
          {f"count(*) filter (regexp_matches({c}, '{NUMBER}'))" if text else "0"} as numlike,
          {f"count(*) filter (regexp_matches({c}, '{DATE}') and try_cast({c} as timestamp) is not null)" if text else "0"} as datelike,
          {f"min({word})" if text else "null"} as lo_w, {f"max({word})" if text else "null"} as hi_w,
          {f"min({c})::double" if number else "null"} as lo, {f"max({c})::double" if number else "null"} as hi,
          {skew} as skew, {int(i == last)} as is_last from {source_sql}""")
    words = profile.TARGET_WORDS
    hits = " or ".join(f"contains(lower(\"column\"), '{w}')" for w in words)
    return f"""
    with facts as ({" union all ".join(parts)}),
    classed as (select *, case
        when filled = 0 then 'categorical'
        when uniq = 2 and ((lo_w, hi_w) in (('false','true'),('no','yes'),('n','y'),('f','t'),('female','male'),('f','m'))
             or (is_number = 1 and lo = 0 and hi = 1)) then 'boolean'
        when uniq / filled > 0.95 and (is_integer = 1 or is_text = 1) then 'identifier'
        when is_date = 1 then 'datetime'
        when is_text = 1 and datelike / filled > 0.8 then 'datetime'
        when is_number = 1 then 'numerical'
        when is_text = 1 and len > 50 then 'text'
        when is_text = 1 and numlike / filled > 0.05 and numlike / filled < 0.95 then 'mixed'
        when is_text = 1 and uniq / filled < 0.5 then 'categorical'
        when is_text = 1 then 'identifier' else 'categorical' end as cls from facts),
    scored as (select *, least(1.0::double, greatest(0.0::double,
        (case when {hits} then 0.3::double else 0 end) + (case when cls = 'boolean' then 0.2::double else 0 end)
        + (case when cls = 'categorical' and uniq <= 10 then 0.2::double else 0 end)
        + (case when cls = 'numerical' and abs(skew) <= 2 then 0.15::double else 0 end)
        + (case when is_last = 1 then 0.15::double else 0 end) - (case when cls = 'identifier' then 0.5::double else 0 end))) as score
        from classed)
    select "column", position, dtype_raw, cls as dtype_class, n_rows, filled as non_null_count,
      n_rows - filled as null_count, {r("(n_rows - filled) / n_rows")} as null_pct, uniq as unique_count,
      {r("case when filled > 0 then uniq / filled else 0 end")} as unique_pct,
      {r("score", 3)} as target_candidate_score, score >= 0.3 as is_target_candidate, skew from scored"""


def profile_columns_sql(source_sql: str, schema) -> str:
    return f"select * exclude (skew) from ({profile_sql(source_sql, schema)})"


def _profiled(df):
    return profile.profile_columns(df).withColumn("position", F.col("position").cast("long"))


query("column_profile", profile_columns_sql("orders", ORDERS))(lambda t: _profiled(t.orders))
query("column_profile_lineitem", profile_columns_sql("lineitem", LINEITEM))(lambda t: _profiled(t.lineitem))
query("column_profile_documents", profile_columns_sql("documents", DOCUMENTS))(lambda t: _profiled(t.documents))
query("column_profile_events", profile_columns_sql("events", EVENTS))(lambda t: _profiled(t.events))
query("column_profile_labelled", profile_columns_sql(LABELLED_SQL, LABELLED))(lambda t: _profiled(labelled(t)))

query("column_types",
      f"""select "column", dtype_class from ({profile_sql('lineitem', LINEITEM)})""")(
    lambda t: typing.column_types(t.lineitem))

query("class_counts",
      f"select dtype_class, count(*) as n from ({profile_sql('lineitem', LINEITEM)}) group by 1")(
    lambda t: profile.class_counts(profile.profile_columns(t.lineitem)))

query("top_target_candidates",
      f"""select "column", target_candidate_score as score, dtype_class as dtype, unique_count, null_pct
      from ({profile_sql('orders', ORDERS)}) order by target_candidate_score desc, position limit 3""")(
    lambda t: profile.top_target_candidates(profile.profile_columns(t.orders)))

query("detect_target",
      f"""select case when target_candidate_score >= 0.3 then "column" end as target, target_candidate_score as confidence
      from ({profile_sql('orders', ORDERS)}) order by target_candidate_score desc, position limit 1""")(
    lambda t: profile.detect_target(profile.profile_columns(t.orders)))

query("numeric_columns_varying", " union all ".join(
    f"""select * from (select '{c}' as "column", {r(f"stddev_samp({c}::double)", 2)} as std from lineitem) where std > 0"""
    for c, t in LINEITEM if t in NUMERIC))(
    lambda t: rounded(typing.varying_columns(t.lineitem), 2))

# --- loading -----------------------------------------------------------------------------------------------

query("table_meta", "select count(*) as rows, 11::bigint as columns, count(*) * 11 as total_cells from lineitem")(
    lambda t: source.table_meta(t.lineitem))

query("read_parquet", "select o_orderkey, o_orderstatus, o_totalprice from orders")(
    lambda t: source.load(t.spark, f"{t.folder}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"))

ROUND_TRIP_SQL = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"


def round_trip(t, fmt: str, table: str = "customer"):
    """A table written to the shared folder in a format and loaded back, with the types of the table."""
    path, df = f"{shared_folder(t.spark)}/round-trip-{uuid.uuid4().hex}", getattr(t, table)
    source.write(df, path, fmt)
    back = source.load(t.spark, path, fmt)
    return back.select(*[C.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])


for _fmt in ("json", "csv", "tsv"):  # texts hold line breaks
    query(f"{_fmt}_round_trip_documents", "select doc_id, nullif(text, '') as text, lang, source, n_chars from documents" if _fmt != "json" else
          "select doc_id, text, lang, source, n_chars from documents")(lambda t, fmt=_fmt: round_trip(t, fmt, "documents"))
query("json_round_trip", ROUND_TRIP_SQL)(lambda t: round_trip(t, "json"))
query("csv_round_trip", ROUND_TRIP_SQL)(lambda t: round_trip(t, "csv"))
query("tsv_round_trip", ROUND_TRIP_SQL)(lambda t: round_trip(t, "tsv"))

query("strip_strings",
      "select o_orderkey, trim(chr(9) || '  ' || o_orderpriority || ' ' || chr(10), ' ' || chr(9) || chr(10)) as p, "
      "o_orderstatus from orders")(
    lambda t: source.strip_strings(t.orders.select(
        "o_orderkey", F.concat(F.lit("\t  "), "o_orderpriority", F.lit(" \n")).alias("p"), "o_orderstatus")))

query("tighten_types",
      "select l_orderkey, l_linenumber, l_quantity::bigint as l_quantity, l_discount from lineitem")(
    lambda t: source.tighten_types(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")))

query("complete_rows", f"select doc_id, quality from {LABELLED_SQL} where quality is not null and lang is not null")(
    lambda t: labelled(t).na.drop(subset=["quality", "lang"]).select("doc_id", "quality"))

HASH = "((({key} % 2147483647) * 2654435761 + {seed}) % 4294967296)"

query("sample_rows",
      f"select o_orderkey, o_totalprice from orders order by {HASH.format(key='o_orderkey', seed=42 * 40503)}, o_orderkey limit 500")(
    lambda t: sampling.sample_rows(t.orders, 500, "o_orderkey").select("o_orderkey", "o_totalprice"))

# --- quality -----------------------------------------------------------------------------------------------

SEVERITY = "case when {p} < 0.05 then 'low' when {p} < 0.3 then 'medium' when {p} < 0.8 then 'high' else 'critical' end"


def missing_sql(source_sql: str, names) -> str:
    parts = " union all ".join(
        f"""select '{c}' as "column", {i}::bigint as position, count(*) - count({c}) as count, count(*) as n_rows from {source_sql}"""
        for i, c in enumerate(names))
    return (f"""select "column", position, count, {r("count / n_rows")} as pct, """
            f"{SEVERITY.format(p='(count / n_rows)')} as severity from ({parts}) where count > 0")


def _missing(df):
    return quality.missing_values(df).withColumn("position", F.col("position").cast("long"))


query("missing_values", missing_sql(LABELLED_SQL, [c for c, _ in LABELLED]))(lambda t: _missing(labelled(t)))

query("worst_missing", missing_sql(LABELLED_SQL, [c for c, _ in LABELLED]) + " order by pct desc, position limit 10")(
    lambda t: score.worst_missing(_missing(labelled(t))))

query("duplicate_rows",
      f"select n - d as count, {r('(n - d) / n')} as pct from (select count(*) as n, "
      "(select count(*) from (select distinct text, lang from documents)) as d from documents)")(
    lambda t: quality.duplicate_rows(t.documents.select("text", "lang")))

query("duplicate_columns",
      "select 'l_quantity' as col_a, 'q2' as col_b union all select 'l_returnflag', 'f2'")(
    lambda t: quality.duplicate_columns(t.lineitem.select(
        "l_orderkey", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus",
        F.col("l_quantity").alias("q2"), F.col("l_returnflag").alias("f2"),
        F.when(F.col("l_linenumber") > 0, F.col("l_tax") + F.col("l_linenumber") * 0.01).alias("t2"))))

# Order priorities in three spellings, prices partly with a currency sign, and numbers mixed with words.
MESSY_SQL = """(select o_orderkey,
  case o_orderkey % 3 when 0 then upper(o_orderpriority) when 1 then lower(o_orderpriority) else ' ' || o_orderpriority end as priority,
  case when o_orderkey % 10 = 0 then '$' || o_custkey::varchar else o_custkey::varchar end as amount,
  case when o_orderkey % 4 = 0 then o_orderstatus else o_custkey::varchar end as code from orders)"""


def messy(t):
    key = F.col("o_orderkey")
    p = F.col("o_orderpriority")
    cust = F.col("o_custkey").cast("string")
    return t.orders.select(
        "o_orderkey",
        F.when(key % 3 == 0, F.upper(p)).when(key % 3 == 1, F.lower(p)).otherwise(F.concat(F.lit(" "), p)).alias("priority"),
        F.when(key % 10 == 0, F.concat(F.lit("$"), cust)).otherwise(cust).alias("amount"),
        F.when(key % 4 == 0, F.col("o_orderstatus")).otherwise(cust).alias("code"))


MESSY_TEXT = ["priority", "amount", "code"]
CASE_SQL = " union all ".join(
    f"""select '{c}' as "column", 'case_inconsistency' as issue_type,
    count(distinct {c}) - count(distinct lower(trim({c}))) as count from {MESSY_SQL}""" for c in MESSY_TEXT)
TEXT_FACTS_SQL = " union all ".join(
    f"""select '{c}' as "column", count({c}) as n, count(*) filter (regexp_matches({c}, '[$%#@€£¥]')) as symbols,
    count(*) filter (regexp_matches(regexp_replace({c}, '[$%,€£¥]', '', 'g'), '{NUMBER}')) as cleaned,
    count(*) filter (regexp_matches({c}, '{NUMBER}')) as num from {MESSY_SQL}""" for c in MESSY_TEXT)
CONSISTENCY_SQL = f"""
  select "column", issue_type, count from ({CASE_SQL}) where count > 0
  union all select "column", 'symbol_contamination', symbols from ({TEXT_FACTS_SQL}) where symbols > 0 and cleaned > 0.5 * symbols
  union all select "column", 'mixed_types', least(num, n - num) from ({TEXT_FACTS_SQL})
    where n >= 5 and num > 5 and n - num > 5 and least(num, n - num) / n > 0.05"""

query("text_consistency", CONSISTENCY_SQL)(lambda t: quality.consistency(messy(t)))

query("case_examples", f"""
  with spellings as (select distinct priority as spelling, lower(trim(priority)) as plain from {MESSY_SQL}),
  several as (select plain, row_number() over (order by plain) as i from spellings group by plain having count(*) > 1)
  select 'priority' as "column", plain, spelling from (
    select s.plain, s.spelling, row_number() over (partition by s.plain order by s.spelling) as k
    from spellings s join several v on s.plain = v.plain where v.i <= 5) where k <= 3""")(
    lambda t: quality.case_examples(messy(t)))

query("symbol_examples", f"""
  select 'amount' as "column", amount as value from (select distinct amount from {MESSY_SQL}
  where regexp_matches(amount, '[$%#@€£¥]')) order by value limit 5""")(
    lambda t: quality.symbol_examples(messy(t)))

# --- statistics --------------------------------------------------------------------------------------------


def rr(expression: str, digits: int) -> str:
    """Four digits first, as the operator reports, then the digits compared."""
    return r(r(expression), digits)


def numeric_sql(source_sql: str, names, wide: tuple[str, ...] = ()) -> str:
    parts = []
    for c in names:
        parts.append(f"""
        select '{c}' as "column", count({c}) as count, {rr(f"avg({c})", 2)} as mean,
          {rr(f"quantile_cont({c}::double, 0.5)", 3)} as median,
          (select {rr("v", 3)} from (select {c}::double as v, count(*) as n from {source_sql} where {c} is not null group by 1 order by n desc, v limit 1)) as mode,
          {rr(f"min({c})::double", 3)} as min, {rr(f"max({c})::double", 3)} as max, {rr(f"max({c})::double - min({c})::double", 3)} as range,
          {rr(f"var_samp({c}::double)", 0)} as variance, {rr(f"stddev_samp({c}::double)", 2)} as std,
          (select {rr("skew", 3)} from m) as skewness, (select {rr("kurt", 3)} from m) as kurtosis,
          {rr(f"quantile_cont({c}::double, 0.25)", 3)} as q1, {rr(f"quantile_cont({c}::double, 0.75)", 3)} as q3,
          {rr(f"quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25)", 3)} as iqr,
          {rr(f"stddev_samp({c}::double) / nullif(avg({c}), 0)", 3)} as cv,
          (select {shape_sql("skew", "kurt")} from m) as distribution_shape
        from {source_sql} having count({c}) >= 2""")
        parts[-1] = f"select * from (with m as {moments_sql(c, source_sql)} {parts[-1]})"
    return " union all ".join(parts)


def shape_sql(s: str, k: str) -> str:
    return (f"case when abs({s}) < 0.5 and abs({k}) < 1 then 'normal' when {s} > 1 then 'right_skewed' "
            f"when {s} < -1 then 'left_skewed' when abs({s}) < 0.5 and {k} > 3 then 'leptokurtic' "
            f"when abs({s}) < 0.5 and {k} < -1 then 'uniform' else 'unknown' end")


def _summary(df, names=None):
    return rounded(stats.numeric_summary(df, names), 3, mean=2, variance=0, std=2)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
query("numeric_summary", numeric_sql("lineitem", MEASURES))(lambda t: _summary(t.lineitem, MEASURES))
query("numeric_summary_events", numeric_sql("events", ["value", "user_id"]))(
    lambda t: _summary(t.events, ["value", "user_id"]))
query("numeric_summary_labelled", numeric_sql(LABELLED_SQL, ["n_chars", "quality", "toxic"]))(
    lambda t: _summary(labelled(t), ["n_chars", "quality", "toxic"]))

query("distribution_shape", " union all ".join(
    f"""select '{c}' as "column", {shape_sql("skew", "kurt")} as distribution_shape from {moments_sql(c, 'lineitem')}"""
    for c in MEASURES))(
    lambda t: stats.numeric_summary(t.lineitem, MEASURES).select("column", "distribution_shape"))


def counts_sql(pairs) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {c}::varchar as value, count(*) as n from {s} where {c} is not null group by 2"""
        for s, c in pairs)


def categorical_sql(pairs) -> str:
    return f"""
    with vc as ({counts_sql(pairs)}),
    per as (select "column", count(*) as u, sum(n) as total, max(n) as most, min(n) as least,
            first(value order by n desc, value) as top from vc group by 1),
    rare as (select vc."column", count(*) filter (vc.n / per.total < 0.01) as rare_count from vc join per using ("column") group by 1)
    select "column", u as unique_count, rare_count, case when most / total > 0.8 then top end as dominant_category,
      {r("most / total")} as dominant_pct, {r("case when u > 1 then most / least end", 2)} as class_imbalance_ratio,
      case when u <= 1 then 'N/A' when most / least < 1.5 then 'balanced' when most / least < 3 then 'mild imbalance'
        when most / least < 10 then 'moderate imbalance' else 'severe imbalance' end as imbalance_label
    from per join rare using ("column")"""


query("categorical_summary", categorical_sql([("documents", "lang"), ("documents", "source"), ("documents", "text")]))(
    lambda t: stats.categorical_summary(C.value_counts(t.documents, ["lang", "source", "text"])))
query("categorical_balance", categorical_sql([("labels", "quality"), ("labels", "toxic")]))(
    lambda t: stats.categorical_summary(C.value_counts(t.labels, ["quality", "toxic"])))
query("top_categories", f"""select * from (select *, row_number() over (partition by "column" order by n desc, value) as place
      from ({counts_sql([("part", "p_name"), ("part", "p_brand"), ("part", "p_type")])})) where place <= 10""")(
    lambda t: stats.top_values(C.value_counts(t.part, ["p_name", "p_brand", "p_type"]), 10)
    .withColumn("place", F.col("place").cast("long")))
query("top_categories_wide", f"""select * from (select *, row_number() over (partition by "column" order by n desc, value) as place
      from ({counts_sql([("events", "props"), ("events", "event_type")])})) where place <= 15""")(
    lambda t: stats.top_values(C.value_counts(t.events, ["props", "event_type"]), 15)
    .withColumn("place", F.col("place").cast("long")))
query("rare_categories", f"""with vc as ({counts_sql([("events", "props"), ("events", "user_id")])})
      select "column", value, n from vc join (select "column", sum(n) as total from vc group by 1) using ("column")
      where n / total < 0.01""")(
    lambda t: stats.rare_values(C.value_counts(t.events, ["props", "user_id"])))

# --- outliers ----------------------------------------------------------------------------------------------

PRICED_SQL = ("(select o_orderkey, sum(l_extendedprice) as total, count(*)::double as lines, max(l_quantity) as most "
              "from orders join lineitem on o_orderkey = l_orderkey group by 1)")


def priced(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(
        F.sum("l_extendedprice").alias("total"), F.count("*").cast("double").alias("lines"), F.max("l_quantity").alias("most"))


def outlier_sql(source_sql: str, names) -> str:
    return " union all ".join(f"""
      select '{c}' as "column", count(*) filter ({c} < lo or {c} > hi) as iqr_outliers,
        count(*) filter (abs(({c} - m) / nullif(s, 0)) > 3) as zscore_outliers,
        {r(f"count(*) filter ({c} < lo or {c} > hi) / count({c})")} as outlier_pct,
        {r("any_value(lo)", 2)} as lower, {r("any_value(hi)", 2)} as upper
      from {source_sql} as d, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi, m, s from (
        select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3, avg({c}) as m,
        stddev_pop({c}::double) as s from {source_sql})) as b""" for c in names)


query("outlier_table", outlier_sql(PRICED_SQL, ["total", "lines", "most"]))(
    lambda t: rounded(outliers.outlier_table(priced(t), ["total", "lines", "most"]), 4, lower=2, upper=2))
query("outlier_table_events", outlier_sql("events", ["value", "user_id"]))(
    lambda t: rounded(outliers.outlier_table(t.events, ["value", "user_id"]), 4, lower=2, upper=2))
query("outlier_examples", " union all ".join(f"""
      select * from (select '{c}' as "column", {c}::double as value, row_number() over (order by {c}) as place from (
        select distinct {c} from {PRICED_SQL} as d, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
        select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from {PRICED_SQL})) as b
        where {c} < lo or {c} > hi)) where place <= 5""" for c in ["lines", "most"]))(
    lambda t: outliers.outlier_examples(priced(t), ["lines", "most"]).withColumn("place", F.col("place").cast("long")))
query("isolation_forest")(lambda t: outliers.isolation_forest(t.lineitem, ["l_extendedprice", "l_quantity"]))
