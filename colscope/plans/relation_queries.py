"""Queries over correlations, tests, table comparison, dates and text."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.operators import compare, correlation, dates, relationships, text
from colscope.plans.profile_queries import LABELLED_SQL, labelled
from colscope.plans.registry import query, r, rounded

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
COARSE = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def corr_sql(method: str, names, expression) -> str:
    return " union all ".join(
        f"select '{method}' as method, '{a}' as col_a, '{b}' as col_b, {r(expression(a, b))} as r"
        for a, b in combinations(names, 2))


def pearson_sql(names, source: str) -> str:
    return corr_sql("pearson", names, lambda a, b: f"(select corr({a}::double, {b}::double) from {source})")


def spearman_sql(names, source: str) -> str:
    def rank(c):
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"

    return corr_sql("spearman", names, lambda a, b: (
        f"(select corr(x::double, y::double) from (select {rank(a)} as x, {rank(b)} as y from {source} "
        f"where {a} is not null and {b} is not null))"))


def kendall_sql(names, source: str) -> str:
    def tau(a, b):
        cells = f"(select {a} as x, {b} as y, count(*)::double as n from {source} where {a} is not null and {b} is not null group by 1, 2)"
        ties = "(select sum(n * (n - 1) / 2) from (select sum(n) as n from {cells} group by {by}))"
        pairs = f"(select sum(n) * (sum(n) - 1) / 2 from {cells})"
        net = f"(select sum(p.n * q.n * sign(p.y - q.y)) from {cells} p, {cells} q where p.x > q.x)"
        return (f"({net} / (sqrt({pairs} - {ties.format(cells=cells, by='x')}) * "
                f"sqrt({pairs} - {ties.format(cells=cells, by='y')})))")

    return corr_sql("kendall", names, tau)


query("pearson_matrix", pearson_sql(MEASURES, "lineitem"))(lambda t: rounded(correlation.pearson(t.lineitem, MEASURES)))
query("spearman_matrix", spearman_sql(MEASURES, "lineitem"))(lambda t: rounded(correlation.spearman(t.lineitem, MEASURES)))
query("kendall_matrix", kendall_sql(COARSE, "lineitem"))(lambda t: rounded(correlation.kendall(t.lineitem, COARSE)))
NULLED = ["n_chars", "quality", "toxic"]
query("correlations_with_nulls", " union all ".join(
    [pearson_sql(NULLED, LABELLED_SQL), spearman_sql(NULLED, LABELLED_SQL), kendall_sql(NULLED, LABELLED_SQL)]))(
    lambda t: rounded(correlation.correlations(labelled(t).select(*NULLED))))

ORDER_SIZES_SQL = ("(select o_totalprice, count(*)::double as lines, sum(l_quantity) as quantity, sum(l_extendedprice) as price, "
                   "sum(l_extendedprice * (1 - l_discount)) as net from orders join lineitem on o_orderkey = l_orderkey "
                   "group by o_orderkey, o_totalprice)")


def order_sizes(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_totalprice").agg(
        F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).drop("o_orderkey")


SIZES = ["o_totalprice", "lines", "quantity", "price", "net"]
PAIRS_SQL = " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, (select corr({a}, {b}) from {ORDER_SIZES_SQL}) as r" for a, b in combinations(SIZES, 2))
query("high_correlation_pairs", f"""select col_a, col_b, {r("r")} as pearson_r,
      case when abs(r) > 0.95 then 'drop one' else 'investigate' end as advice from ({PAIRS_SQL}) where abs(r) > 0.8""")(
    lambda t: correlation.high_pairs(correlation.pearson(order_sizes(t), SIZES)))
query("correlation_with_target", f"""select case when col_a = 'net' then col_b else col_a end as "column", abs({r("r")}) as abs_r
      from ({PAIRS_SQL}) where col_a = 'net' or col_b = 'net'""")(
    lambda t: correlation.by_target_correlation(correlation.pearson(order_sizes(t), SIZES), "net"))

# --- tests: the statistics are stated in SQL, the tail probabilities are checked in the tests ----------------

query("pearson_test", f"select {r('corr(l_quantity, l_extendedprice)')} as pearson_r, count(*) as n from lineitem")(
    lambda t: relationships.number_vs_number(t.lineitem, "l_quantity", "l_extendedprice").select("pearson_r", "n"))


def anova_sql(x: str, g: str, source: str, least: int = 3) -> str:
    return f"""select {r("(b / (k - 1)) / (w / (n - k))", 3)} as f_statistic, k as n_groups from (
      select count(*) as k, sum(n) as n, sum(n * pow(m - grand, 2)) as b, sum(w) as w from (
        select *, sum(n * m) over () / sum(n) over () as grand from (
          select {g} as g, count({x}) as n, avg({x}) as m, var_pop({x}::double) * count({x}) as w
          from {source} where {g} is not null group by 1 having count({x}) >= {least}))) where k >= 2"""


query("anova_test", anova_sql("value", "event_type", "events"))(
    lambda t: rounded(relationships.number_vs_category(t.events, "value", "event_type").select("f_statistic", "n_groups"), 3))
query("anova_test_many_groups", anova_sql("value", "user_id", "events"))(
    lambda t: rounded(relationships.number_vs_category(t.events, "value", "user_id").select("f_statistic", "n_groups"), 3))


def chi_sql(a: str, b: str, source: str) -> str:
    return f"""with o as (select {a} as a, {b} as b, count(*)::double as o from {source} where {a} is not null and {b} is not null group by 1, 2),
      ra as (select a, sum(o) as ro from o group by 1), cb as (select b, sum(o) as co from o group by 1),
      cells as (select coalesce(o.o, 0) as o, ro * co / (select sum(o) from o) as e from ra cross join cb left join o using (a, b)),
      shape as (select (select count(*) from ra) as nr, (select count(*) from cb) as nc, (select sum(o) from o) as n),
      stat as (select case when (nr - 1) * (nc - 1) = 1
        then (select sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) from cells)
        else (select sum(pow(o - e, 2) / e) from cells) end as chi2, nr, nc, n from shape)
      select {r("chi2")} as chi2, (nr - 1) * (nc - 1) as dof, {r("sqrt(chi2 / (n * (least(nr, nc) - 1)))")} as cramers_v
      from stat where least(nr, nc) >= 2"""


query("chi_square_test", chi_sql("l_returnflag", "l_linestatus", "lineitem"))(
    lambda t: relationships.category_vs_category(t.lineitem, "l_returnflag", "l_linestatus").select("chi2", "dof", "cramers_v"))
query("chi_square_two_by_two", chi_sql("quality", "toxic", "labels"))(
    lambda t: relationships.category_vs_category(t.labels, "quality", "toxic").select("chi2", "dof", "cramers_v"))
query("chi_square_sparse", chi_sql("user_id", "props", "events"))(
    lambda t: relationships.category_vs_category(t.events, "user_id", "props").select("chi2", "dof", "cramers_v"))

# --- two tables --------------------------------------------------------------------------------------------

OLD_SQL = "(select * from orders where o_orderdate < timestamp '1998-01-01')"
NEW_SQL = "(select * exclude (o_totalprice), o_totalprice * 1.05 as o_totalprice, 1 as o_extra from orders where o_orderdate >= timestamp '1998-01-01')"


def old_orders(t):
    return t.orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))


def new_orders(t):
    rows = t.orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.withColumn("o_totalprice", F.col("o_totalprice") * 1.05).withColumn("o_extra", F.lit(1))


def ks_sql(names, a: str, b: str) -> str:
    return " union all ".join(f"""
      select '{c}' as "column", {r(f"(select avg({c}) from {a})", 2)} as mean_a, {r(f"(select avg({c}) from {b})", 2)} as mean_b,
        {r(f"(select stddev_samp({c}::double) from {a})", 2)} as std_a, {r(f"(select stddev_samp({c}::double) from {b})", 2)} as std_b,
        {r("max(abs(fa - fb))")} as ks_statistic from (
        select sum(na) over (order by v) / sum(na) over () as fa, sum(nb) over (order by v) / sum(nb) over () as fb from (
          select v, sum(na) as na, sum(nb) as nb from (
            select {c}::double as v, count(*) as na, 0 as nb from {a} group by 1 union all
            select {c}::double, 0, count(*) from {b} group by 1) group by 1))""" for c in names)


def ks_p_sql(names, a: str, b: str) -> str:
    """p by the limit law, whatever the number of rows."""
    return " union all ".join(f"""
      select "column", {r("p")} as ks_pvalue, p < 0.05 as shift_detected from (
        select "column", case when l < 0.2 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
          lambda k: pow(-1, k - 1) * exp(-2 * pow(k * l, 2)))))) end as p
        from (select '{c}' as "column", d * (root + 0.12 + 0.11 / root) as l from (
          select max(abs(fa - fb)) as d, any_value(sqrt(n1 * n2 / (n1 + n2))) as root from (
            select sum(na) over (order by v) / sum(na) over () as fa, sum(nb) over (order by v) / sum(nb) over () as fb,
              (sum(na) over ())::double as n1, (sum(nb) over ())::double as n2 from (
              select v, sum(na) as na, sum(nb) as nb from (
                select {c}::double as v, count(*) as na, 0 as nb from {a} group by 1 union all
                select {c}::double, 0, count(*) from {b} group by 1) group by 1)))))""" for c in names)


query("distribution_shift_p_values", ks_p_sql(["o_totalprice", "o_custkey"], OLD_SQL, NEW_SQL))(
    lambda t: rounded(compare.distribution_shifts(old_orders(t), new_orders(t), ["o_totalprice", "o_custkey"], exact_rows=0).select(
        "column", "ks_pvalue", "shift_detected")))
query("distribution_shifts", ks_sql(["o_totalprice", "o_custkey"], OLD_SQL, NEW_SQL))(
    lambda t: rounded(compare.distribution_shifts(old_orders(t), new_orders(t), ["o_totalprice", "o_custkey"])
                      .drop("ks_pvalue", "shift_detected"), 4, mean_a=2, mean_b=2, std_a=2, std_b=2))
RETURNED, KEPT = "(select * from lineitem where l_returnflag = 'R')", "(select * from lineitem where l_returnflag <> 'R')"
query("distribution_shifts_lineitem", ks_sql(["l_quantity", "l_extendedprice", "l_discount"], RETURNED, KEPT))(
    lambda t: rounded(compare.distribution_shifts(
        t.lineitem.filter("l_returnflag = 'R'"), t.lineitem.filter("l_returnflag <> 'R'"),
        ["l_quantity", "l_extendedprice", "l_discount"]).drop("ks_pvalue", "shift_detected"),
        4, mean_a=2, mean_b=2, std_a=2, std_b=2))

query("null_drift", f"""select * from (
      select 'quality' as "column", {r("a")} as null_pct_a, {r("b")} as null_pct_b, {r("b - a")} as change, a, b from (
        select (select 1 - count(quality) / count(*) from {LABELLED_SQL} where lang = 'en') as a,
               (select 1 - count(quality) / count(*) from {LABELLED_SQL} where lang <> 'en') as b)
      union all select 'toxic', {r("a")}, {r("b")}, {r("b - a")}, a, b from (
        select (select 1 - count(toxic) / count(*) from {LABELLED_SQL} where lang = 'en') as a,
               (select 1 - count(toxic) / count(*) from {LABELLED_SQL} where lang <> 'en') as b)) where abs(b - a) > 0.01""".replace(
    "select * from (", 'select "column", null_pct_a, null_pct_b, change from (', 1))(
    lambda t: compare.null_drift(labelled(t).filter("lang = 'en'"), labelled(t).filter("lang <> 'en'")))

query("row_overlap", f"""select sum(na * nb)::bigint as common_rows, {r("sum(na * nb) / (select count(*) from lineitem where l_returnflag = 'R') * 100", 2)} as overlap_pct
      from (select l_quantity, l_discount, l_tax, count(*) as na from lineitem where l_returnflag = 'R' group by 1, 2, 3)
      join (select l_quantity, l_discount, l_tax, count(*) as nb from lineitem where l_returnflag <> 'R' group by 1, 2, 3)
      using (l_quantity, l_discount, l_tax)""")(
    lambda t: compare.row_overlap(
        t.lineitem.filter("l_returnflag = 'R'").select("l_quantity", "l_discount", "l_tax"),
        t.lineitem.filter("l_returnflag <> 'R'").select("l_quantity", "l_discount", "l_tax")))

query("row_overlap_with_nulls", f"""select sum(na * nb)::bigint as common_rows, {r("sum(na * nb) / (select count(*) from documents where lang = 'en') * 100", 2)} as overlap_pct
      from (select toxic, quality, count(*) as na from {LABELLED_SQL} where lang = 'en' group by 1, 2) x
      join (select toxic, quality, count(*) as nb from {LABELLED_SQL} where lang <> 'en' group by 1, 2) y
      on x.toxic is not distinct from y.toxic and x.quality is not distinct from y.quality""")(
    lambda t: compare.row_overlap(labelled(t).filter("lang = 'en'").select("toxic", "quality"),
                                  labelled(t).filter("lang <> 'en'").select("toxic", "quality")))

query("size_diff", f"""select a as rows_a, b as rows_b, b - a as row_diff, 6::bigint as cols_a, 7::bigint as cols_b from (
      select (select count(*) from {OLD_SQL}) as a, (select count(*) from {NEW_SQL}) as b)""")(
    lambda t: compare.size_diff(old_orders(t), new_orders(t)))


def typed_orders(t):
    return new_orders(t).withColumn("o_custkey", F.col("o_custkey").cast("string")).drop("o_orderpriority")


SCHEMA_SQL = """(values ('o_orderkey', 'bigint', 'bigint', 'same'), ('o_custkey', 'bigint', 'string', 'dtype_change'),
      ('o_orderstatus', 'string', 'string', 'same'), ('o_totalprice', 'double', 'double', 'same'),
      ('o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'same'), ('o_orderpriority', 'string', null, 'only_in_a'),
      ('o_extra', null, 'int', 'only_in_b'))"""
query("schema_diff", f"""select * from {SCHEMA_SQL} as s("column", dtype_a, dtype_b, status)""")(
    lambda t: compare.schema_diff(old_orders(t), typed_orders(t)))
query("column_sets", """select * from (values ('o_orderkey', 'common'), ('o_custkey', 'common'), ('o_orderstatus', 'common'),
      ('o_totalprice', 'common'), ('o_orderdate', 'common'), ('o_orderpriority', 'only_in_a'), ('o_extra', 'only_in_b'))
      as s("column", kind)""")(
    lambda t: compare.column_sets(old_orders(t), typed_orders(t)))

# --- dates -------------------------------------------------------------------------------------------------

SHIPPED_SQL = """(select o_orderdate, strftime(o_orderdate, '%m/%d/%Y') as us_date,
      case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as half_date, o_orderpriority from orders)"""


def shipped(t):
    return t.orders.select(
        "o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("half_date"), "o_orderpriority")


query("date_columns", f"""select * from (
      select 'o_orderdate' as "column", 1.0::double as date_share
      union all select 'us_date', count(try_strptime(us_date, '%m/%d/%Y')) / count(*) from {SHIPPED_SQL}
      union all select 'half_date', count(try_strptime(half_date, '%Y-%m-%d')) / count(*) from {SHIPPED_SQL}
      union all select 'o_orderpriority', count(try_strptime(o_orderpriority, '%Y-%m-%d')) / count(*) from {SHIPPED_SQL})
      where date_share > 0.8""")(
    lambda t: dates.date_columns(shipped(t)))


def date_summary_sql(pairs) -> str:
    return " union all ".join(f"""
      select '{c}' as "column", strftime(min({e}), '%Y-%m-%d') as min_date, strftime(max({e}), '%Y-%m-%d') as max_date,
        floor(epoch(max({e}) - min({e})) / 86400)::bigint as range_days, bool_or(hour({e}) <> 0) as has_time_component,
        floor(epoch(max({e}) - min({e})) / 86400) >= 365 as has_seasonality, 'unknown' as trend_direction from {s}"""
        for s, c, e in pairs)


query("date_summary", date_summary_sql([("events", "ts", "ts")]))(lambda t: dates.date_summary(t.events))
query("date_summary_text", date_summary_sql([
    (SHIPPED_SQL, "o_orderdate", "o_orderdate"), (SHIPPED_SQL, "us_date", "strptime(us_date, '%m/%d/%Y')")]))(
    lambda t: dates.date_summary(shipped(t)))
EUROPEAN_SQL = "(select *, strftime(o_orderdate, '%d/%m/%Y') as day_first, strftime(o_orderdate, '%d-%m-%Y') as dashed from orders)"


def european(t):
    return t.orders.select(*[F.date_format("o_orderdate", f).alias(n) for n, f in (("day_first", "dd/MM/yyyy"), ("dashed", "dd-MM-yyyy"))],
                           "o_orderpriority")


query("date_summary_day_first", date_summary_sql([
    (EUROPEAN_SQL, "day_first", "date_trunc('day', o_orderdate)"), (EUROPEAN_SQL, "dashed", "date_trunc('day', o_orderdate)")]))(
    lambda t: dates.date_summary(european(t)))
query("weekday_counts_day_first", """select 'day_first' as "column", (isodow(o_orderdate) - 1)::int as weekday, count(*) as n from orders group by 2""")(
    lambda t: dates.weekday_counts(european(t), ["day_first"]))
query("monthly_counts", """select 'o_orderdate' as "column", strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 2
      union all select 'us_date', strftime(strptime(us_date, '%m/%d/%Y'), '%Y-%m'), count(*) from """ + SHIPPED_SQL + " group by 2")(
    lambda t: dates.monthly_counts(shipped(t)))
query("weekday_counts", """select 'l_shipdate' as "column", (isodow(l_shipdate) - 1)::int as weekday, count(*) as n from lineitem group by 2""")(
    lambda t: dates.weekday_counts(t.lineitem))
query("date_parts", """select event_id, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day, isodow(ts) - 1 as ts_weekday,
      quarter(ts) as ts_quarter, isodow(ts) >= 6 as ts_is_weekend, hour(ts) as ts_hour from events""")(
    lambda t: dates.add_date_parts(t.events.select("event_id", "ts"), "ts").drop("ts"))
query("date_parts_without_time", """select o_orderkey, year(o_orderdate) as o_orderdate_year, month(o_orderdate) as o_orderdate_month,
      day(o_orderdate) as o_orderdate_day, isodow(o_orderdate) - 1 as o_orderdate_weekday, quarter(o_orderdate) as o_orderdate_quarter,
      isodow(o_orderdate) >= 6 as o_orderdate_is_weekend from orders""")(
    lambda t: dates.add_date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate"))

# --- text --------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
WORDS = (r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), "
         r"lambda x: regexp_full_match(x, '[a-z]{{3,}}') and x not in (" + STOP + "))")


def words_sql(table: str, c: str) -> str:
    return f"(select unnest({WORDS.format(c=c)}) as value from {table})"


def ngrams_sql(table: str, c: str, n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return (f"(select unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) as value "
            f"from (select {WORDS.format(c=c)} as w from {table}) where len(w) >= {n})")


def top_sql(c: str, rows: str, k: int) -> str:
    return f"""select '{c}' as "column", value, n, row_number() over (order by n desc, value) as place from (
      select value, count(*) as n from {rows} group by 1) qualify place <= {k}"""


def placed(df):
    return df.withColumn("place", F.col("place").cast("long"))


query("text_lengths", " union all ".join(
    f"""select '{c}' as "column", {r(f"avg(length({c}))", 1)} as avg_length, max(length({c})) as max_length, min(length({c})) as min_length from {s}"""
    for s, c in [("documents", "text")]))(lambda t: text.text_lengths(t.documents, ["text"]))
query("word_totals", f"""select 'text' as "column", count(*) as total_words, count(distinct value) as vocabulary_size from {words_sql("documents", "text")}""")(
    lambda t: text.word_totals(text.word_counts(t.documents, ["text"])))
query("word_counts", f"""select 'text' as "column", value, count(*) as n from {words_sql("documents", "text")} group by 2""")(
    lambda t: text.word_counts(t.documents, ["text"]))
query("top_words", top_sql("text", words_sql("documents", "text"), 20))(
    lambda t: placed(text.top_terms(text.word_counts(t.documents, ["text"]), 20)))
query("top_bigrams", top_sql("text", ngrams_sql("documents", "text", 2), 15))(
    lambda t: placed(text.top_terms(text.ngram_counts(t.documents, ["text"], 2), 15)))
query("top_trigrams", top_sql("text", ngrams_sql("conversations", "text", 3), 15))(
    lambda t: placed(text.top_terms(text.ngram_counts(t.conversations, ["text"], 3), 15)))
query("top_bigrams_across_rows", top_sql("text", f"""(select value || ' ' || after as value from (
      select value, lead(value) over (order by doc_id, i) as after from (
        select doc_id, unnest(w) as value, generate_subscripts(w, 1) as i from (select doc_id, {WORDS.format(c="text")} as w from documents))) where after is not null)""", 15))(
    lambda t: placed(text.top_terms(text.ngram_counts(t.documents, ["text"], 2, across_rows="doc_id"), 15)))
query("text_analysis_pages", f"""select * from (
      select 'html' as "column", {r("avg(length(html))", 1)} as avg_length, max(length(html)) as max_length, min(length(html)) as min_length from pages)
      join (select 'html' as "column", count(*) as total_words, count(distinct value) as vocabulary_size from {words_sql("pages", "html")}) using ("column")""")(
    lambda t: text.text_analysis(t.pages, ["html"])["summary"])
