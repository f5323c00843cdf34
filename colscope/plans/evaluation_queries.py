"""Queries over prediction metrics, curves and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.operators import chartdata, evaluate
from colscope.functions.normal import CENTRE_BOTTOM, CENTRE_TOP, MIDDLE_BOTTOM, MIDDLE_TOP, TAIL_BOTTOM, TAIL_TOP
from colscope.plans.profile_queries import LABELLED_SQL, HASH, labelled
from colscope.plans.registry import query, r, rounded

# Two scorers of whether a line item was shipped late in its year, and three-class guesses of the return flag,
# all plain functions of the line items.
SCORED_SQL = """(select l_orderkey, l_linenumber, model, y, score, case when score >= 0.5 then 1 else 0 end as pred from (
      select l_orderkey, l_linenumber, (month(l_shipdate) > 6)::int as y, 'by_month' as model,
        least(0.99, greatest(0.01, (month(l_shipdate) * 5 + l_quantity) / 110)) as score from lineitem
      union all select l_orderkey, l_linenumber, (month(l_shipdate) > 6)::int, 'by_quantity', l_quantity / 51 from lineitem))"""


def scored(t):
    late = (F.month("l_shipdate") > 6).cast("int")
    by_month = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.month("l_shipdate") * 5 + F.col("l_quantity")) / 110))
    each = F.explode(F.array(
        F.struct(F.lit("by_month").alias("model"), by_month.alias("score")),
        F.struct(F.lit("by_quantity").alias("model"), (F.col("l_quantity") / 51).alias("score"))))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", late.alias("y"), each.alias("m")).select(
        "l_orderkey", "l_linenumber", "y", "m.*")
    return rows.withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))


GUESSED_SQL = """(select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y, l_linenumber % 3 as pred,
      [p0, p1, 1 - p0 - p1] as prob from (select *, 0.1 + l_discount * 3 as p0, 0.2 + l_tax * 2 as p1 from lineitem))"""


def guessed(t):
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    p0, p1 = 0.1 + F.col("l_discount") * 3, 0.2 + F.col("l_tax") * 2
    return t.lineitem.select(y.alias("y"), (F.col("l_linenumber") % 3).alias("pred"), F.array(p0, p1, 1 - p0 - p1).alias("prob"))


query("confusion_matrix", f"""select model, y, pred, n, {r("n / sum(n) over (partition by model, y)")} as share from (
      select model, y, pred, count(*) as n from {SCORED_SQL} group by 1, 2, 3)""")(
    lambda t: rounded(evaluate.confusion(scored(t), ["model"])))


def metrics_sql(source: str, by: str) -> str:
    return f"""with c as (select {by} as model, y, pred, count(*)::double as n from {source} group by 1, 2, 3),
      k as (select model, class, coalesce(max(s), 0) as s, coalesce(max(h), 0) as h, coalesce(max(g), 0) as g from (
        select model, y as class, sum(n) as s, sum(case when y = pred then n else 0 end) as h, null as g from c group by 1, 2
        union all select model, pred, null, null, sum(n) from c group by 1, 2) group by 1, 2),
      m as (select *, sum(s) over (partition by model) as n, case when g > 0 then h / g else 0 end as p, case when s > 0 then h / s else 0 end as rc,
        case when s + g > 0 then 2 * h / (s + g) else 0 end as f from k)
      select model, {r("sum(h) / sum(s)")} as accuracy, {r("sum(p * s) / sum(s)")} as precision_weighted, {r("sum(rc * s) / sum(s)")} as recall_weighted,
        {r("sum(f * s) / sum(s)")} as f1_weighted, {r("avg(f)")} as f1_macro, {r("avg((n - s - (g - h)) / nullif(n - s, 0))")} as specificity,
        {r("coalesce((sum(h) * sum(s) - sum(s * g)) / nullif(sqrt(sum(s) * sum(s) - sum(g * g)) * sqrt(sum(s) * sum(s) - sum(s * s)), 0), 0)")} as mcc
      from m group by 1"""


query("classification_metrics", metrics_sql(SCORED_SQL, "model"))(
    lambda t: rounded(evaluate.classification_metrics(scored(t), ["model"])))
query("classification_metrics_multiclass", metrics_sql(GUESSED_SQL, "'guess'"))(
    lambda t: rounded(evaluate.classification_metrics(guessed(t).withColumn("model", F.lit("guess")), ["model"])))


def auc_sql(source: str, y: str, s: str) -> str:
    return f"""(select (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))
      from (select y::double as y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk
      from (select {y} as y, {s} as s from {source})))"""


query("roc_auc", " union all ".join(
    f"select '{m}' as model, {r(auc_sql('(select * from ' + SCORED_SQL + f' where model = {chr(39)}{m}{chr(39)})', 'y', 'score'))} as roc_auc"
    for m in ["by_month", "by_quantity"]))(
    lambda t: rounded(evaluate.roc_auc(scored(t), ["model"])))
query("roc_auc_multiclass", f"""select {r("sum(a * s) / sum(s)")} as roc_auc from ({" union all ".join(
    f"select {auc_sql(GUESSED_SQL, f'(y = {k})::int', f'prob[{k + 1}]')} as a, (select count(*) from {GUESSED_SQL} where y = {k}) as s" for k in range(3))})""")(
    lambda t: rounded(evaluate.roc_auc_multiclass(guessed(t), 3)))
query("log_loss", f"select model, {r('avg(-ln(case when y = 1 then score else 1 - score end))')} as logloss from {SCORED_SQL} group by 1")(
    lambda t: rounded(evaluate.log_loss(scored(t), ["model"], F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score")))))

ESTIMATED_SQL = """(select l_orderkey, l_linenumber, l_extendedprice as y, model, case model when 'by_quantity' then l_quantity * 2080.0
      else 53000.0 + l_tax * 100 end as pred, (l_orderkey % 5)::int as fold from lineitem, (values ('by_quantity'), ('by_tax')) as m(model))"""


def estimated(t):
    each = F.explode(F.array(
        F.struct(F.lit("by_quantity").alias("model"), (F.col("l_quantity") * 2080.0).alias("pred")),
        F.struct(F.lit("by_tax").alias("model"), (53000.0 + F.col("l_tax") * 100).alias("pred"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), each.alias("m"),
                             (F.col("l_orderkey") % 5).cast("int").alias("fold")).select(
        "l_orderkey", "l_linenumber", "y", "m.*", "fold")


R2 = "1 - avg(pow(y - pred, 2)) / var_pop(y)"
query("regression_metrics", f"""select model, {r("avg(pow(y - pred, 2))", -3)} as mse, {r("sqrt(avg(pow(y - pred, 2)))", 2)} as rmse,
      {r("avg(abs(y - pred))", 2)} as mae, {r(R2)} as r2, {r("avg(abs((y - pred) / nullif(y, 0))) * 100")} as mape,
      {r("sqrt(avg(pow(y - pred, 2))) / avg(y) * 100")} as cvrmse from {ESTIMATED_SQL} group by 1""")(
    lambda t: rounded(evaluate.regression_metrics(estimated(t), ["model"]), 4, mse=-3, rmse=2, mae=2))
FOLDS_SQL = f"(select model, fold, {R2} as score from {ESTIMATED_SQL} group by 1, 2)"
query("fold_scores", f"select model, fold, {r('score')} as score from {FOLDS_SQL}")(
    lambda t: rounded(evaluate.fold_scores(estimated(t), "regression")))
query("cross_validation_summary", f"select model, {r('avg(score)')} as cv_mean, {r('stddev_pop(score)')} as cv_std from {FOLDS_SQL} group by 1")(
    lambda t: rounded(evaluate.fold_summary(evaluate.fold_scores(estimated(t), "regression"))))
query("pairwise_comparison", f"""select model_a, model_b, {r("avg(d) / (stddev_samp(d) / sqrt(count(*)))")} as t from (
      select a.model as model_a, b.model as model_b, a.score - b.score as d from {FOLDS_SQL} a join {FOLDS_SQL} b using (fold) where a.model <> b.model) group by 1, 2""")(
    lambda t: rounded(evaluate.pairwise_comparison(evaluate.fold_scores(estimated(t), "regression")).drop("p_better")))
query("residuals", f"select l_orderkey, l_linenumber, model, y, pred, {r('y - pred')} as residual from {ESTIMATED_SQL}")(
    lambda t: rounded(evaluate.residuals(estimated(t).drop("fold"))))

STEPS_SQL = f"""(select model, score, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as p,
      sum(neg) over (partition by model) as n from (select model, score, sum(y) as pos, sum(1 - y) as neg from {SCORED_SQL} group by 1, 2)
      window w as (partition by model order by score desc))"""
query("roc_points", f"select model, {r('score', 6)} as score, {r('fp / n')} as fpr, {r('tp / p')} as tpr from {STEPS_SQL}")(
    lambda t: rounded(evaluate.roc_points(scored(t), ["model"]), 4, score=6))
query("precision_recall_points", f"select model, {r('score', 6)} as score, {r('tp / (tp + fp)')} as precision, {r('tp / p')} as recall from {STEPS_SQL}")(
    lambda t: rounded(evaluate.precision_recall_points(scored(t), ["model"]), 4, score=6))
query("gains_and_lift", f"""select model, {r('score', 6)} as score, {r('(tp + fp) / (p + n)')} as fraction, {r('tp / p')} as gain,
      {r('tp / p / ((tp + fp) / (p + n))')} as lift from {STEPS_SQL}""")(
    lambda t: rounded(evaluate.gains_and_lift(scored(t), ["model"]), 4, score=6))
query("calibration", f"""select model, greatest(1, ceil(score * 10))::bigint as bin, count(*) as n, {r("avg(score)")} as mean_predicted,
      {r("avg(y)")} as fraction_positive from {SCORED_SQL} group by 1, 2""")(
    lambda t: rounded(evaluate.calibration(scored(t), ["model"])))

# --- chart data --------------------------------------------------------------------------------------------


def histogram_sql(table: str, x: str, bins: int) -> str:
    return f"""select bin, {r("lo + bin * w")} as low, {r("lo + bin * w + w")} as high, n, {r("n / (t * w)", 8)} as density from (
      select least({bins - 1}, floor(({x} - lo) / w))::int as bin, any_value(lo) as lo, any_value(w) as w, count(*) as n, any_value(t) as t
      from {table}, (select min({x}) as lo, (max({x}) - min({x})) / {bins} as w, count({x}) as t from {table}) where {x} is not null group by 1)"""


query("histogram", histogram_sql("events", "value", 30))(
    lambda t: rounded(chartdata.histogram(t.events, "value", 30), 4, density=8))


def density_sql(source: str, x: str, points: int, extra: str = "") -> str:
    return f"""select {extra} point::int as point, {r("any_value(lo + point * step)")} as x,
      {r("sum(n * exp(-pow((lo + point * step - v) / h, 2) / 2)) / any_value(rows * h * sqrt(2 * pi()))", 8)} as density
      from (select v, n, lo, (hi - lo) / {points - 1} as step, rows, s * pow(rows, -0.2) as h from
        (select {x} as v, count(*) as n from {source} where {x} is not null group by 1) as c,
        (select min({x}) as lo, max({x}) as hi, count({x}) as rows, stddev_samp({x}::double) as s from {source}) as f) as k,
        range(0, {points}) as g(point) group by point"""


query("kernel_density", density_sql("events", "value", 200))(
    lambda t: rounded(chartdata.kernel_density(t.events, "value"), 4, density=8))
query("violin", " union all ".join(
    density_sql(f"(select * from events where event_type = '{g}')", "value", 200, f"'{g}' as \"group\",")
    for g in ["click", "error", "purchase", "signup", "view"]))(
    lambda t: rounded(chartdata.violin(t.events, "value", "event_type"), 4, density=8))


def box_sql(source: str, x: str, label: str, name: str) -> str:
    return f"""select '{name}' as "{label}", count({x}) as n, {r("any_value(q1)")} as q1, {r("any_value(q2)")} as median, {r("any_value(q3)")} as q3,
      {r(f"avg({x})")} as mean, {r(f"stddev_pop({x}::double)")} as sd,
      {r(f"min({x}) filter ({x} >= q1 - 1.5 * (q3 - q1) and {x} <= q3 + 1.5 * (q3 - q1))")} as whisker_low,
      {r(f"max({x}) filter ({x} >= q1 - 1.5 * (q3 - q1) and {x} <= q3 + 1.5 * (q3 - q1))")} as whisker_high,
      count(*) filter ({x} < q1 - 1.5 * (q3 - q1) or {x} > q3 + 1.5 * (q3 - q1)) as n_outliers
      from {source} as d, (select quantile_cont({x}::double, 0.25) as q1, quantile_cont({x}::double, 0.5) as q2, quantile_cont({x}::double, 0.75) as q3 from {source}) as q"""


query("box_stats", " union all ".join(box_sql("lineitem", c, "column", c) for c in ["l_quantity", "l_extendedprice", "l_discount"]))(
    lambda t: rounded(chartdata.box_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])))
query("box_stats_by_group", " union all ".join(
    box_sql(f"(select * from events where event_type = '{g}')", "value", "group", g) for g in ["click", "error", "purchase", "signup", "view"]))(
    lambda t: rounded(chartdata.box_stats_by_group(t.events, "value", "event_type")))
query("trend_line", f"""select {r("regr_slope(l_extendedprice, l_quantity)")} as slope, {r("regr_intercept(l_extendedprice, l_quantity)", 2)} as intercept,
      {r("corr(l_quantity, l_extendedprice)")} as r, count(*) as n from lineitem""")(
    lambda t: rounded(chartdata.trend_line(t.lineitem, "l_quantity", "l_extendedprice"), 4, intercept=2))
query("time_series", "select ts, value from events where value is not null")(lambda t: chartdata.time_series(t.events, "ts", "value"))
query("pair_plot", f"select n_chars, quality, toxic, lang from {LABELLED_SQL} where quality is not null")(
    lambda t: chartdata.pair_plot(labelled(t), ["n_chars", "quality", "toxic"], "lang"))
query("missing_pattern", f"""select 0 as doc_id, (lang is null)::int as lang, (n_chars is null)::int as n_chars, (quality is null)::int as quality,
      (toxic is null)::int as toxic from {LABELLED_SQL} order by {HASH.format(key='doc_id', seed=42 * 40503)}, doc_id limit 200""")(
    lambda t: chartdata.missing_pattern(labelled(t), 200, "doc_id"))


def polynomial(coefficients, x: str) -> str:
    out = repr(coefficients[-1])
    for a in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {a!r})"
    return out


NEAR, FAR = "(0.180625::double - q * q)", "far"
INVERSE_NORMAL = f"""case when abs(q) <= 0.425 then q * {polynomial(CENTRE_TOP, NEAR)} / {polynomial(CENTRE_BOTTOM, NEAR)}
      else sign(q) * (case when far <= 5 then {polynomial(MIDDLE_TOP, "(far - 1.6)")} / {polynomial(MIDDLE_BOTTOM, "(far - 1.6)")}
      else {polynomial(TAIL_TOP, "(far - 5)")} / {polynomial(TAIL_BOTTOM, "(far - 5)")} end) end"""
QQ_SQL = f"""(select position, value, {INVERSE_NORMAL} as quantile from (select *, p - 0.5 as q, sqrt(-ln(least(p, 1 - p))) as far from (
      select position, value, case when position = n then pow(0.5, 1.0 / n) when position = 1 then 1 - pow(0.5, 1.0 / n)
        else (position - 0.3175) / (n + 0.365) end::double as p from (
        select value, row_number() over (order by value) as position, (count(*) over ())::double as n from events where value is not null))))"""
query("normal_quantiles", f"select position, value, {r('quantile', 6)} as quantile from {QQ_SQL}")(
    lambda t: rounded(chartdata.normal_quantiles(t.events, "value"), 6))
query("normal_quantile_line", f"select {r('regr_slope(value, quantile)')} as slope, {r('regr_intercept(value, quantile)')} as intercept, {r('corr(value, quantile)')} as r from {QQ_SQL}")(
    lambda t: rounded(chartdata.normal_line(chartdata.normal_quantiles(t.events, "value"))))
