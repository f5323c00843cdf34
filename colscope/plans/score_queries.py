"""Queries over scores, recommendations, cleaning, transforms, sampling and feature ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.operators import clean, correlation, outliers, profile, quality, rank, sampling, score, stats, transforms
from colscope.plans.profile_queries import (
    HASH, LABELLED, LABELLED_SQL, LINEITEM, ORDERS, categorical_sql, labelled, moments_sql, outlier_sql, profile_sql)
from colscope.plans.registry import query, r, rounded
from colscope.plans.relation_queries import ORDER_SIZES_SQL, PAIRS_SQL, SIZES, order_sizes

DOC_FACTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
             ("quality", "int"), ("toxic", "int")]
DOCS_SQL = "(select d.*, quality, toxic from documents d left join labels using (doc_id))"


def docs(t):
    return t.documents.join(t.labels, "doc_id", "left")


def _health_parts(df, numeric, categorical, target):
    p = profile.profile_columns(df)
    matrix = correlation.pearson(df, C.numeric_columns(df))
    return score.health_score(p, outliers.outlier_table(df, numeric), quality.duplicate_rows(df),
                              correlation.high_pairs(matrix), stats.categorical_summary(C.value_counts(df, categorical)), target)


def health_sql(source: str, schema, numeric, categorical, pairs, target) -> str:
    from itertools import combinations

    high = " + ".join(f"(select (abs(corr({a}::double, {b}::double)) > 0.8)::int from {source})" for a, b in combinations(pairs, 2))
    mine = f"""(select class_imbalance_ratio from ({categorical_sql([(source, c) for c in categorical])}) where "column" = '{target}')"""
    balance = (f"(select greatest(0.0, coalesce(100 - ({mine} - 1) * 11, 100.0)))" if target in categorical else "80.0")
    return f"""with s as (select
        greatest(0.0, 100 - 100 * (select avg(null_pct) from ({profile_sql(source, schema)}))) as ms,
        greatest(0.0, 100 - 200 * (select avg(outlier_pct) from ({outlier_sql(source, numeric)}))) as os,
        greatest(0.0, 100 - 300 * (select round_even((n - d) / n::double, 4) from (select count(*) as n,
          (select count(*) from (select distinct * from {source})) as d from {source}))) as ds,
        {balance} as cs, greatest(0.0, 100.0 - 10 * (coalesce({high}, 0))) as rs),
      w as (select *, ms * 0.3 + os * 0.2 + ds * 0.15 + cs * 0.2 + rs * 0.15 as total, least(ms, os, ds, cs, rs) as lowest from s)
      select {r("total", 1)} as total, {r("ms", 1)} as missing_score, {r("os", 1)} as outlier_score, {r("ds", 1)} as duplicate_score,
        {r("cs", 1)} as class_balance_score, {r("rs", 1)} as correlation_score,
        case when total >= 85 then 'A' when total >= 70 then 'B' when total >= 55 then 'C' else 'D' end as grade,
        case lowest when ms then 'Missing Values' when os then 'Outliers' when ds then 'Duplicates' when cs then 'Class Balance' else 'Correlations' end as worst_dimension,
        case lowest when ms then '{score.DIMENSIONS["missing_score"][1]}' when os then '{score.DIMENSIONS["outlier_score"][1]}'
          when ds then '{score.DIMENSIONS["duplicate_score"][1]}' when cs then '{score.DIMENSIONS["class_balance_score"][1]}'
          else '{score.DIMENSIONS["correlation_score"][1]}' end as one_line_fix from w"""


DOC_HEALTH = (DOCS_SQL, DOC_FACTS, ["n_chars"], ["lang", "source", "text"], ["doc_id", "n_chars", "quality", "toxic"], "lang")
query("health_score", health_sql(*DOC_HEALTH))(lambda t: _health_parts(docs(t), ["n_chars"], ["lang", "source", "text"], "lang"))
query("health_score_orders", health_sql("orders", ORDERS, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"],
                                        ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice"))(
    lambda t: _health_parts(t.orders, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], "o_totalprice"))
query("health_breakdown", f"""unpivot (select missing_score as "Missing Values", outlier_score as "Outliers", duplicate_score as "Duplicates",
      class_balance_score as "Class Balance", correlation_score as "Correlations" from ({health_sql(*DOC_HEALTH)}))
      on columns(*) into name dimension value score""")(
    lambda t: score.health_breakdown(_health_parts(docs(t), ["n_chars"], ["lang", "source", "text"], "lang")))


def problem_sql(source: str, schema, target: str) -> str:
    return f"""with p as ({profile_sql(source, schema)}), f as (select bool_or(dtype_class = 'datetime') as dated,
        max(case when "column" = '{target}' then dtype_class end) as cls, max(case when "column" = '{target}' then unique_count end) as u from p)
      select case when dated then 'timeseries' when cls in ('categorical', 'boolean') then 'classification'
          when cls = 'numerical' then 'regression' else 'classification' end as problem_type,
        case when dated then 0.75 when cls in ('categorical', 'boolean') then case when u = 2 then 0.95 when u <= 20 then 0.85 else 0.6 end
          when cls = 'numerical' then 0.9 else 0.5 end::double as confidence from f"""


for _name, _target in [("problem_type", "toxic"), ("problem_type_regression", "n_chars"), ("problem_type_many_classes", "lang")]:
    query(_name, problem_sql(LABELLED_SQL, LABELLED, _target))(
        lambda t, target=_target: score.problem_type(profile.profile_columns(labelled(t)), target))
query("problem_type_dated", problem_sql("orders", ORDERS, "o_orderstatus"))(
    lambda t: score.problem_type(profile.profile_columns(t.orders), "o_orderstatus"))
query("readiness", f"""with p as ({profile_sql(LABELLED_SQL, LABELLED)}), f as (select max(n_rows) as n, count(*) as c,
        max(case when "column" = 'toxic' then null_pct end) as tn, count(*) filter (dtype_class <> 'identifier' and "column" <> 'toxic') as fe,
        count(*) filter (null_pct > 0.2) as sp from p)
      select 'blocker' as kind, 'too_few_rows' as code, n::double as amount from f where n < 50
      union all select 'blocker', 'target_mostly_null', tn from f where tn > 0.5
      union all select 'blocker', 'only_identifiers', fe from f where fe = 0
      union all select 'blocker', 'too_few_features', fe from f where fe < 1
      union all select 'warning', 'small_table', n from f where n between 50 and 199
      union all select 'warning', 'many_sparse_columns', sp from f where sp > c * 0.3""")(
    lambda t: score.readiness(profile.profile_columns(labelled(t)), "toxic"))

SKEWS = lambda source, schema: f"(select * from ({profile_sql(source, schema)}))"


def preprocessing_sql(source: str, schema, robust=()) -> str:
    over = ", ".join(f"'{c}'" for c in robust) or "''"
    return f"""with p as {SKEWS(source, schema)}, k as (select *, dtype_class <> 'identifier' and null_pct <= 0.8 as keep from p)
      select "column", not keep as drop, case when dtype_class = 'identifier' then 'identifier' when null_pct > 0.8 then 'mostly_null' end as drop_reason,
        case when keep then case when dtype_class = 'numerical' then case when abs(round_even(skew, 4)) > 1 then 'median' else 'mean' end
          when dtype_class = 'datetime' then 'none' else 'mode' end end as imputation,
        case when keep and dtype_class in ('categorical', 'boolean') then case when unique_count <= 10 then 'one_hot'
          when unique_count <= 50 then 'ordinal' else 'frequency' end end as encoding,
        case when keep and dtype_class = 'numerical' then case when "column" in ({over}) then 'robust' else 'standard' end end as scaling from k"""


def _advice(df, with_outliers=False):
    p = profile.profile_columns(df)
    names = [n for n in C.numeric_columns(df)]
    extra = outliers.outlier_table(df, names) if with_outliers else None
    return p, score.preprocessing(p, stats.skewness(df, names), extra)


query("preprocessing_advice", preprocessing_sql(DOCS_SQL, DOC_FACTS))(lambda t: _advice(docs(t))[1])
query("preprocessing_advice_lineitem", preprocessing_sql("lineitem", LINEITEM))(lambda t: _advice(t.lineitem, True)[1])


def suggestions_sql(source: str, schema) -> str:
    def rule(name, suffix, condition):
        return f"""select "column", '{name}' as rule_name, "column" || '{suffix}' as new_column from p where {condition}"""

    return f"with p as {SKEWS(source, schema)} " + " union all ".join([
        rule("datetime_extraction", "_year", "dtype_class = 'datetime'"),
        rule("age_binning", "_group", "dtype_class = 'numerical' and contains(lower(\"column\"), 'age')"),
        rule("text_length", "_length", "dtype_class = 'text'"),
        rule("log_transform", "_log", "dtype_class = 'numerical' and abs(round_even(skew, 4)) > 1.5"),
        rule("category_frequency", "_freq", "dtype_class = 'categorical' and unique_count > 10")])


def _suggestions(df):
    return score.feature_suggestions(profile.profile_columns(df), stats.skewness(df))


query("feature_suggestions", suggestions_sql("documents", DOC_FACTS[:5]))(lambda t: _suggestions(t.documents))
query("feature_suggestions_lineitem", suggestions_sql("lineitem", LINEITEM))(lambda t: _suggestions(t.lineitem))

# The headline over documents: worst missing, outlying and correlated items.
query("headline", f"""
      (select 'missing' as kind, "column" as item, null_pct as amount from ({profile_sql(DOCS_SQL, DOC_FACTS)}) where null_count > 0 order by amount desc, item limit 5)
      union all (select 'outliers', "column", outlier_pct from ({outlier_sql(DOCS_SQL, ["n_chars", "doc_id"])}) order by outlier_pct desc, "column" limit 5)""")(
    lambda t: score.headline(quality.missing_values(docs(t)), outliers.outlier_table(docs(t), ["n_chars", "doc_id"]),
                             correlation.high_pairs(correlation.pearson(docs(t), ["doc_id", "n_chars", "quality", "toxic"]))))

query("headline_sizes", f"""
      (select 'outliers' as kind, "column" as item, outlier_pct as amount from ({outlier_sql(ORDER_SIZES_SQL, SIZES)}) order by outlier_pct desc, "column" limit 5)
      union all (select 'correlation', col_a || '~' || col_b as item, {r("r")} as amount from ({PAIRS_SQL}) where abs(r) > 0.8 order by abs(amount) desc, item limit 5)""")(
    lambda t: score.headline(quality.missing_values(order_sizes(t)), outliers.outlier_table(order_sizes(t), SIZES),
                             correlation.high_pairs(correlation.pearson(order_sizes(t), SIZES))))

# --- cleaning ----------------------------------------------------------------------------------------------

# Labelled languages with repeated rows and untidy spelling.
DIRTY = [("lang", "string"), ("source", "string"), ("size", "int"), ("quality", "int")]
DIRTY_SQL = """(select case when doc_id % 2 = 0 then ' ' || upper(lang) else lang end as lang, source,
      case when doc_id % 7 = 0 then null else (n_chars // 100)::int end as size, quality
      from documents left join labels using (doc_id))"""
CLEANED_SQL = f"""with d as (select distinct * from {DIRTY_SQL}),
      n as (select lower(trim(lang)) as lang, lower(trim(source)) as source, size, quality from d),
      fill as (select (select avg(size) from n) as mean_size, (select quantile_cont(size::double, 0.5) from n) as median_size,
        (select quality from n where quality is not null group by 1 order by count(*) desc, 1 limit 1) as q)"""


def dirty(t):
    odd = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang"))
    size = F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("n_chars") / 100).cast("int"))
    return t.documents.join(t.labels, "doc_id", "left").select(odd.alias("lang"), "source", size.alias("size"), "quality")


def cleaned(t, choices):
    df = dirty(t)
    p, advice = _advice(df)
    return clean.clean(df, p, advice, choices)


query("clean_table", f"""{CLEANED_SQL} select lang, source, {r("coalesce(size, median_size)")} as size, coalesce(quality, q) as quality from n, fill""")(
    lambda t: rounded(cleaned(t, {"size": {"imputation": "median"}}).df))
query("clean_table_mean", f"""with d as (select distinct lang, size, quality from {DIRTY_SQL}),
      n as (select lower(trim(lang)) as lang, size, quality from d), f as (select avg(size) as m from n)
      select lang, {r("coalesce(size, m)")} as size, quality from n, f""")(
    lambda t: rounded(cleaned(t, {"source": {"drop": True}, "size": {"imputation": "mean"}, "quality": {"imputation": "none"}}).df))
query("clean_report", f"""{CLEANED_SQL} select (select count(*) from documents) as rows_before, 4::bigint as columns_before,
      (select count(*) from n) as rows_after, 4::bigint as columns_after,
      (select count(*) from documents) - (select count(*) from n) as removed_duplicates,
      (select count(*) - count(size) + count(*) - count(quality) from {DIRTY_SQL}) as null_count_before, 0::bigint as null_count_after""")(
    lambda t: cleaned(t, {"size": {"imputation": "median"}}).report)
query("distinct_rows", "select distinct lang, source, n_chars from documents")(
    lambda t: t.documents.select("lang", "source", "n_chars").dropDuplicates())
query("normalise_categories", f"select lower(trim(lang)) as lang, source, size, quality from {DIRTY_SQL}")(
    lambda t: clean.normalise_categories(dirty(t), {"lang": "categorical"}))

# --- transforms --------------------------------------------------------------------------------------------

query("age_groups", """select p_partkey, p_size, case when p_size > 0 and p_size <= 12 then 'child' when p_size > 12 and p_size <= 17 then 'teen'
      when p_size > 17 and p_size <= 64 then 'adult' when p_size > 64 and p_size <= 200 then 'senior' end as p_size_group from part""")(
    lambda t: transforms.add_age_group(t.part.select("p_partkey", "p_size"), "p_size"))
query("text_length_feature", "select doc_id, length(text) as text_length from documents")(
    lambda t: transforms.add_text_length(t.documents.select("doc_id", "text"), "text").drop("text"))
query("log_feature", f"select c_custkey, {r('ln(1 + greatest(c_acctbal, 0))')} as c_acctbal_log from customer")(
    lambda t: rounded(transforms.add_log(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")))
query("frequency_feature", """select doc_id, quality, coalesce(case when quality is not null then count(*) over (partition by quality) end, 0) as quality_freq
      from """ + LABELLED_SQL)(
    lambda t: transforms.add_frequency(labelled(t).select("doc_id", "quality"), "quality"))
query("label_codes", "select value, dense_rank() over (order by value) - 1 as code from (select distinct p_name as value from part)")(
    lambda t: transforms.label_codes(t.part, "p_name"))
query("label_code_feature", "select p_partkey, dense_rank() over (order by p_brand) - 1 as p_brand_code from part")(
    lambda t: transforms.add_label_code(t.part.select("p_partkey", "p_brand"), "p_brand").drop("p_brand"))
query("class_weights", f"""select value, {r("t / (k * n)")} as weight from (select toxic as value, count(*)::double as n,
      sum(count(*)) over () as t, count(*) over () as k from labels group by 1)""")(
    lambda t: rounded(transforms.class_weights(t.labels, "toxic")))

# --- splits ------------------------------------------------------------------------------------------------

ORDER_HASH = HASH.format(key="l_orderkey", seed=42 * 40503)


def numbered_sql(table: str, key: str, strata: str | None, seed: int = 42) -> str:
    part = f"partition by {strata}" if strata else ""
    return f"row_number() over ({part} order by {HASH.format(key=key, seed=seed * 40503)}, {key}) - 1"


query("stratified_folds", f"select o_orderkey, o_orderstatus, (({numbered_sql('orders', 'o_orderkey', 'o_orderstatus')}) % 5)::int as fold from orders")(
    lambda t: sampling.with_folds(t.orders.select("o_orderkey", "o_orderstatus"), 5, "o_orderkey", "o_orderstatus"))
query("train_test_split", f"""select o_orderkey, floor((i + 1) * 0.2::double) > floor(i * 0.2::double) as is_test from (
      select o_orderkey, {numbered_sql('orders', 'o_orderkey', 'o_orderpriority', 7)} as i from orders)""")(
    lambda t: sampling.with_split(t.orders.select("o_orderkey", "o_orderpriority"), 0.2, "o_orderkey", "o_orderpriority", 7)
    .drop("o_orderpriority"))

# --- feature ranking ---------------------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def flagged(t):
    """Line items with the return flag nudging quantity and discount, so that features differ in worth."""
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.select(
        F.col("l_returnflag").alias("y"), (F.col("l_quantity") + 2 * code).alias("l_quantity"), "l_extendedprice",
        (F.col("l_discount") + 0.01 * code).alias("l_discount"), "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"))


FLAGGED_SQL = """(select l_returnflag as y, l_quantity + 2 * c as l_quantity, l_extendedprice, l_discount + 0.01 * c as l_discount, l_tax,
      l_linenumber::double as l_linenumber from (select *, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as c from lineitem))"""

query("rank_anova", " union all ".join(f"""select '{c}' as feature, {r("(b / (k - 1)) / (w / (n - k))", 3)} as score from (
      select count(*) as k, sum(n) as n, sum(n * pow(m - g, 2)) as b, sum(w) as w from (select *, sum(n * m) over () / sum(n) over () as g from (
      select y, count(*) as n, avg({c}) as m, var_pop({c}::double) * count(*) as w from {FLAGGED_SQL} group by 1)))""" for c in FEATURES))(
    lambda t: rounded(rank.anova(rank.class_moments(flagged(t), FEATURES)), 3))
query("rank_chi2", " union all ".join(f"""select '{c}' as feature, {r("sum(pow(o - e, 2) / e)", 3)} as score from (
      select o, sum(o) over () * n / sum(n) over () as e from (select y, count(*)::double as n, sum(({c} - lo) / (hi - lo)) as o
      from {FLAGGED_SQL} as d, (select min({c}) as lo, max({c}) as hi from {FLAGGED_SQL}) as b group by 1))""" for c in FEATURES))(
    lambda t: rounded(rank.chi_square(rank.class_moments(flagged(t), FEATURES)), 3))


def information_sql(c: str, cells: str) -> str:
    return f"""select '{c}' as feature, {r("greatest(0, sum(n / t * ln(n * t / (nx * ny))))", 5)} as score from (
      select n, sum(n) over () as t, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny from
      (select x, y, count(*)::double as n from {cells} group by 1, 2))"""


query("rank_information", " union all ".join(
    [information_sql("l_linenumber", f"(select l_linenumber as x, y from {FLAGGED_SQL})")]
    + [information_sql(c, f"(select " + " + ".join(
        f"({c} > (select quantile_cont({c}::double, {k / 10}) from {FLAGGED_SQL}))::int" for k in range(1, 10))
        + f" as x, y from {FLAGGED_SQL})") for c in ["l_extendedprice", "l_quantity"]]))(
    lambda t: rounded(rank.mutual_information(
        rank.binned(flagged(t), ["l_extendedprice", "l_quantity"]), ["l_linenumber", "l_extendedprice", "l_quantity"]), 5))

SIZES_SQL = ("(select l_extendedprice * (1 - l_discount) as y, l_quantity, l_discount, l_tax, l_linenumber::double as l_linenumber from lineitem)")
query("rank_regression", " union all ".join(f"""select '{c}' as feature, {r("r * r / (1 - r * r) * (n - 2)", 2)} as score from (
      select corr(y, {c}) as r, count(*) as n from {SIZES_SQL})""" for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))(
    lambda t: rounded(rank.regression_f(t.lineitem.select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), "l_quantity", "l_discount", "l_tax", "l_linenumber"),
        ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 2))
query("rank_features")(lambda t: rank.rank_features(
    t.orders, profile.profile_columns(t.orders), "o_orderstatus", "classification", "information"))
