"""Queries over preprocessing, learners, neighbours, clusters and forecasts."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.staging import shared_folder
from colscope.operators import cluster, features, forecast, learners, neighbours, rank, smote
from colscope.plans import modelling
from colscope.plans.profile_queries import HASH, LABELLED_SQL, labelled
from colscope.plans.registry import query, r, rounded

# --- preprocessing -------------------------------------------------------------------------------------------


def slots(df, groups, keep):
    pre = features.fit_preprocessor(df, groups)
    return features.apply_preprocessor(pre, df).select(*keep, *features.as_columns(pre))


def many_levels(t):
    """Sparse vectors of a number and a text column with nearly as many levels as rows, one of them frequent, some null: the
    filled slot behind the number, as (line, slot, value, size)."""
    word = F.when(F.col("l_linenumber") > 4, "common").when(F.col("l_linenumber") > 1, F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"))
    rows = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_quantity", word.alias("w"))
    pre = features.fit_preprocessor(rows, {**NO_GROUPS, "standard": ["l_quantity"], "one_hot": ["w"]})
    v = F.unwrap_udt("features")
    made = features.apply_preprocessor(pre, rows)
    return made.select("line", F.inline(F.arrays_zip(v["indices"].alias("slot"), v["values"].alias("value"))), v["size"].cast("long").alias("size")).filter(
        "slot > 0").select("line", F.col("slot").cast("long").alias("slot"), "value", "size")


NO_GROUPS = {"standard": [], "robust": [], "minmax": [], "one_hot": [], "ordinal": []}


def scaled(df, kind, names, keep):
    out = slots(df, {**NO_GROUPS, kind: names}, [C.col(k) for k in keep])
    return rounded(out)


def scale_sql(source: str, names, keep, expression) -> str:
    return f"select {keep}, {', '.join(r(expression(n, source)) + f' as {n}' for n in names)} from {source}"


def filled(n, source, fill="avg({n})"):
    return f"coalesce({n}::double, (select {fill.format(n=n)} from {source}))"


query("scale_standard", scale_sql(LABELLED_SQL, ["n_chars", "quality"], "doc_id", lambda n, s: (
    f"({filled(n, s)} - (select avg({n}) from {s})) / (select sqrt(var_pop({n}::double) * count({n}) / count(*)) from {s})")))(
    lambda t: scaled(labelled(t), "standard", ["n_chars", "quality"], ["doc_id"]))
query("scale_robust", scale_sql("events", ["value", "user_id"], "event_id", lambda n, s: (
    f"({n} - (select quantile_cont({n}::double, 0.5) from {s})) / (select quantile_cont({n}::double, 0.75) - quantile_cont({n}::double, 0.25) from {s})")))(
    lambda t: scaled(t.events, "robust", ["value", "user_id"], ["event_id"]))
query("scale_minmax", scale_sql(LABELLED_SQL, ["n_chars", "toxic"], "doc_id", lambda n, s: (
    f"({filled(n, s)} - (select min({n}) from {s})) / (select max({n}) - min({n}) from {s})")))(
    lambda t: scaled(labelled(t), "minmax", ["n_chars", "toxic"], ["doc_id"]))
query("encode_one_hot", "select o_orderkey, " + ", ".join(
    f"(o_orderstatus = '{v}')::int::double as o_orderstatus_{v}" for v in "FOP") + " from orders")(
    lambda t: slots(t.orders, {**NO_GROUPS, "one_hot": ["o_orderstatus"]}, ["o_orderkey"]))
query("encode_many_levels", """with words as (select l_orderkey * 8 + l_linenumber as line, case when l_linenumber > 4 then 'common' when l_linenumber > 1
        then l_orderkey::varchar || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey end as w from lineitem),
      codes as (select w, row_number() over (order by w) - 1 as code from (select distinct w from words where w is not null))
      select line, 1 + code as slot, 1.0::double as value, 1 + (select count(*) from codes) as size from words
      join codes on codes.w = coalesce(words.w, (select w from words where w is not null group by w order by count(*) desc, w limit 1))""")(lambda t: many_levels(t))
query("encode_ordinal", f"""select doc_id, (dense_rank() over (order by lang) - 1)::double as lang,
      coalesce(quality, (select quality from {LABELLED_SQL} where quality is not null group by 1 order by count(*) desc, 1 limit 1))::double as quality from {LABELLED_SQL}""")(
    lambda t: slots(labelled(t).withColumn("q", F.col("quality")).drop("toxic").withColumn("quality", F.col("q")).drop("q"),
                    {**NO_GROUPS, "ordinal": ["lang", "quality"]}, ["doc_id"]))

CLASSES = {"o_orderkey": "identifier", "o_custkey": "numerical", "o_orderstatus": "categorical", "o_totalprice": "numerical",
           "o_orderdate": "datetime", "o_orderpriority": "categorical"}
PRICE_CLASSES = {"l_quantity": "numerical", "l_discount": "numerical", "l_tax": "numerical", "l_returnflag": "categorical",
                 "l_extendedprice": "numerical", "line": "identifier"}


def lines(t):
    """Line items with a row key and a price that depends on quantity and discount."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_quantity", "l_discount", "l_tax", "l_returnflag",
        (F.col("l_quantity") * 1000 - F.col("l_discount") * 20000 + F.col("l_extendedprice") / 10).alias("l_extendedprice"))


# --- learners ------------------------------------------------------------------------------------------------


query("linear_regression", f"""select {r("regr_slope(l_extendedprice, l_quantity)")} as slope, {r("regr_intercept(l_extendedprice, l_quantity)", 2)} as intercept from lineitem""")(
    lambda t: _line(t))


def _line(t):
    frame = t.lineitem.select(F.lit(0).alias("id"), F.col("l_extendedprice").alias("y"), array_to_vector(F.array("l_quantity")).alias("features"))
    model = learners.fit("regression", "linear_regression", frame).model
    return rounded(t.spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"),
                   4, intercept=2)


query("ridge_regression", f"""with f as (select avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem),
      s as (select sum((l_quantity - mx) * (l_extendedprice - my)) / (sum(pow(l_quantity - mx, 2)) + 1000000) as b, any_value(mx) as mx, any_value(my) as my from lineitem, f)
      select {r("b")} as slope, {r("my - b * mx", 2)} as intercept from s""")(
    lambda t: _ridge(t))


def _ridge(t):
    frame = t.lineitem.select(F.lit(0).alias("id"), F.col("l_extendedprice").alias("y"), array_to_vector(F.array("l_quantity")).alias("features"))
    model = learners.fit("regression", "ridge", frame, {"alpha": 1_000_000.0}).model
    return rounded(t.spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"),
                   4, intercept=2)


query("constant_baseline", f"""select o_orderkey as id, (select code from (select dense_rank() over (order by o_orderstatus) - 1 as code, count(*) as n
      from orders group by o_orderstatus) order by n desc, code limit 1)::double as pred,
      {r("(select count(*) filter (o_orderstatus = 'F') / count(*) from orders)")} as p_f from orders""")(
    lambda t: _constant(t))


def _constant(t):
    code = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    frame = t.orders.select(F.col("o_orderkey").alias("id"), code.alias("y"))
    out = learners.fit("classification", "constant", frame, {}, 3).predict(frame)
    return rounded(out.select("id", "pred", F.get("prob", F.lit(0)).alias("p_f")))


query("leave_one_out_constant", f"""select l_orderkey * 8 + l_linenumber as id, {r("(sum(y) over () - y) / (count(*) over () - 1)", 2)} as pred from (
      select l_orderkey, l_linenumber, l_quantity * 1000 - l_discount * 20000 + l_extendedprice / 10 as y from lineitem)""")(
    lambda t: rounded(modelling.leave_one_out(_prepared(t), "constant").select("id", "pred"), 2))


def _prepared(t):
    return modelling.prepare(lines(t), "l_extendedprice", "regression", PRICE_CLASSES, key="line")


PRICE_SQL = "(select l_orderkey * 8 + l_linenumber as id, l_quantity as x, l_quantity * 1000 - l_discount * 20000 + l_extendedprice / 10 as y from lineitem)"
ONE_CLASS = {"l_quantity": "numerical", "l_extendedprice": "numerical", "line": "identifier"}


def _one_feature(t):
    return modelling.prepare(lines(t).select("line", "l_quantity", "l_extendedprice"), "l_extendedprice", "regression", ONE_CLASS, key="line")


query("leave_one_out_linear", f"""with f as (select avg(x) as mx, count(*) as n, var_pop(x) * count(*) as sxx, regr_slope(y, x) as b, regr_intercept(y, x) as a from {PRICE_SQL})
      select id, {r("y", 2)} as y, {r("y - (y - a - b * x) / (1 - 1 / n - pow(x - mx, 2) / sxx)", 2)} as pred from {PRICE_SQL}, f""")(
    lambda t: rounded(modelling.leave_one_out(_one_feature(t), "linear_regression").select("id", "y", "pred"), 2))
query("leave_one_out_linear_all")(lambda t: modelling.leave_one_out(_prepared(t), "linear_regression").select("id", "y", "pred"))

OLD = "o_orderkey % 3 <> 0"
NEW_ROWS_SQL = f"""with old as (select * from orders where {OLD}), new as (select * from orders where not ({OLD}))
      select o_orderkey as id, {r(r("(select avg(o_totalprice) from old)"), 2)} as constant,
        {r(r("(select regr_intercept(o_totalprice, o_custkey) from old) + (select regr_slope(o_totalprice, o_custkey) from old) * o_custkey"), 2)} as linear from new"""


@query("predictions_new_rows", NEW_ROWS_SQL)
def _new_rows(t):
    """Fitted on two thirds of the orders, applied to the rest without the target, the linear learner after saving and loading it."""
    columns = {"o_orderkey": "identifier", "o_custkey": "numerical", "o_totalprice": "numerical"}
    orders = t.orders.select(*columns)
    p = modelling.prepare(orders.filter(OLD), "o_totalprice", "regression", columns, key="o_orderkey")
    path = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    modelling.fit_pipe(p, p.rows, "linear_regression").save(path)
    fitted = {"constant": modelling.fit_pipe(p, p.rows, "constant"), "linear": modelling.load(t.spark, path)}
    table = modelling.predictions_table(p, fitted, orders.filter(f"not ({OLD})").drop("o_totalprice"), key="o_orderkey")
    return rounded(table.groupBy("id").pivot("model", ["constant", "linear"]).agg(F.first("predicted")), 2)


def embedded(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
                               F.col("label").cast("long").alias("label"))


PAIRS_SQL = """(select a.vec_id as id, b.vec_id as neighbour, a.label as own, b.label as label,
      sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::double - p[2]::double, 2)))) as distance
      from embeddings a, embeddings b where a.vec_id <> b.vec_id)"""
query("nearest_vectors", f"""select id, neighbour, {r("distance")} as distance, place from (select *, row_number() over (partition by id order by distance, neighbour) as place
      from {PAIRS_SQL}) where place <= 5""")(
    lambda t: rounded(neighbours.k_nearest(embedded(t), embedded(t), 5, exclude_self=True).withColumn("place", F.col("place").cast("long"))))
query("nearest_neighbour_vote", f"""select id, label::double as pred, {r("n / 5.0")} as share from (select id, label, count(*) as n,
      row_number() over (partition by id order by count(*) desc, label) as k from (select *, row_number() over (partition by id order by distance, neighbour) as place
      from {PAIRS_SQL}) where place <= 5 group by 1, 2) where k = 1""")(
    lambda t: _vote(t))


def vector_frame(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"),
                               array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _vote(t):
    frame = vector_frame(t)
    out = learners.fit("classification", "nearest_neighbours", frame, {}, 10).predict(frame, exclude_self=True)
    return rounded(out.select("id", "pred", F.array_max("prob").alias("share")))


def clustered(t):
    """Embeddings with their labels as clusters."""
    return vector_frame(t).withColumn("cluster", F.col("y").cast("int")).drop("y")


query("silhouette", f"""select id, any_value(own) as cluster, {r("(min(b) - max(a)) / greatest(min(b), max(a))")} as silhouette from (
      select id, own, case when own = label then avg(distance) end as a, case when own <> label then avg(distance) end as b
      from {PAIRS_SQL} group by id, own, label) group by id""")(
    lambda t: rounded(cluster.silhouette(clustered(t))))
query("silhouette_squared", f"""select id, any_value(own) as cluster, {r("(min(b) - max(a)) / greatest(min(b), max(a))")} as silhouette from (
      select id, own, case when own = label then avg(distance * distance) end as a, case when own <> label then avg(distance * distance) end as b
      from {PAIRS_SQL} group by id, own, label) group by id""")(
    lambda t: rounded(cluster.silhouette_squared(clustered(t))))
query("silhouette_bars", f"""select cluster, row_number() over (partition by cluster order by silhouette desc, id) as place, id, silhouette from (
      select id, any_value(own) as cluster, {r("(min(b) - max(a)) / greatest(min(b), max(a))")} as silhouette from (
      select id, own, case when own = label then avg(distance * distance) end as a, case when own <> label then avg(distance * distance) end as b
      from {PAIRS_SQL} group by id, own, label) group by id)""")(
    lambda t: cluster.silhouette_bars(rounded(cluster.silhouette_squared(clustered(t)))))

# --- runs, checked by their number of rows here and by their results in the tests ----------------------------


def _scores(t, models, scheme):
    rows = lines(t)
    return modelling.test_and_score(rows, "l_extendedprice", "regression", models, PRICE_CLASSES, scheme, refit=False, key="line")


ORDER_SQL = "(select o_orderkey as id, o_custkey::double as x, o_totalprice as y from orders)"
ORDER_CLASSES = {"o_orderkey": "identifier", "o_custkey": "numerical", "o_totalprice": "numerical"}


def numbered_sql(seed: int) -> str:
    """The rows numbered in hash order."""
    return f"(select *, row_number() over (order by {HASH.format(key='id', seed=seed * 40503)}, id) - 1 as k from {ORDER_SQL})"


LINE = {"linear_regression": None, "constant": None}
FITTED = "regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(y) as c"
FOLDS_SQL = f"""f as (select id, x, y, (k % 5)::int as fold from {numbered_sql(42)}),
      m as (select h.fold, {FITTED} from f join (select distinct fold from f) h on f.fold <> h.fold group by 1),
      p as (select 'linear_regression' as model, fold, id, y, a + b * x as pred from f join m using (fold)
        union all select 'constant', fold, id, y, c from f join m using (fold))"""
REPEATS_SQL = "p as (" + " union all ".join(f"""select 'linear_regression' as model, {n} as fold, id, y, a + b * x as pred
      from (select *, floor((k + 1) * 0.3::double) > floor(k * 0.3::double) as test from {numbered_sql(42 + n)}),
      (select {FITTED} from (select *, floor((k + 1) * 0.3::double) > floor(k * 0.3::double) as test from {numbered_sql(42 + n)}) where not test)
      where test""" for n in range(3)) + ")"
TRAIN_SQL = f"""p as (select 'linear_regression' as model, y, a + b * x as pred from {ORDER_SQL}, (select {FITTED} from {ORDER_SQL}) union all
      select 'constant', y, c from {ORDER_SQL}, (select {FITTED} from {ORDER_SQL}))"""
ERRORS = f"""select model, {r("sqrt(avg(pow(y - pred, 2)))", 2)} as rmse, {r("avg(abs(y - pred))", 2)} as mae,
      {r("1 - avg(pow(y - pred, 2)) / var_pop(y)")} as r2 from p group by 1"""


def _order_line(t):
    return modelling.prepare(t.orders.select(*ORDER_CLASSES), "o_totalprice", "regression", ORDER_CLASSES, key="o_orderkey")


def _line_scores(t, scheme):
    rows = t.orders.select(*ORDER_CLASSES)
    made = modelling.test_and_score(rows, "o_totalprice", "regression", LINE, ORDER_CLASSES, scheme, refit=False, key="o_orderkey")
    return rounded(made.metrics.select("model", "rmse", "mae", "r2"), 4, rmse=2, mae=2)


query("cross_validated_predictions", f"with {FOLDS_SQL} select model, fold, id, {r('y', 2)} as y, {r('pred', 2)} as pred from p")(
    lambda t: rounded(modelling.cross_predictions(_order_line(t), LINE), 2))
query("repeated_split_predictions", f"with {REPEATS_SQL} select model, fold, id, {r('y', 2)} as y, {r('pred', 2)} as pred from p")(
    lambda t: rounded(modelling.repeated_predictions(_order_line(t), {"linear_regression": None}), 2))
query("cross_validated_line_scores", f"with {FOLDS_SQL} {ERRORS}")(lambda t: _line_scores(t, {"k": 5}))
query("train_line_scores", f"with {TRAIN_SQL} {ERRORS}")(lambda t: _line_scores(t, {"method": "test_on_train"}))
query("cross_validated_scores")(lambda t: _scores(t, {"linear_regression": None, "constant": None}, {"k": 5}).metrics)
query("repeated_split_scores")(lambda t: _scores(t, {"ridge": None}, {"method": "random_sampling"}).metrics)
query("train_split_scores")(lambda t: _scores(t, {"decision_tree": None}, {"method": "test_on_train"}).metrics)
query("learner_comparison")(lambda t: _scores(t, {"linear_regression": None, "decision_tree": None}, {"k": 5}).comparison)
query("leaderboard")(lambda t: modelling.leaderboard(
    t.orders, "o_orderstatus", "classification", CLASSES, key="o_orderkey").drop("train_seconds"))
query("predictions_table")(lambda t: _predicted(t))


def _predicted(t):
    p = modelling.prepare(t.orders, "o_orderstatus", "classification", CLASSES, key="o_orderkey")
    return modelling.predictions_table(p, {"naive_bayes": modelling.fit_pipe(p, p.rows, "naive_bayes")})


query("feature_importance")(lambda t: _importance(t))


def _importance(t):
    p = _prepared(t)
    pairs = modelling.fit_pipe(p, p.rows, "random_forest").importance()
    return t.spark.createDataFrame([(n, float(v)) for n, v in pairs], "feature string, importance double")


query("rank_regression_table", " union all ".join(f"""select '{n}' as feature, {r(f"pow(corr({n}, y), 2) * (count(*) - 2) / (1 - pow(corr({n}, y), 2))", 2)} as score
      from (select *, l_quantity * 1000 - l_discount * 20000 + l_extendedprice / 10 as y from lineitem)""" for n in ("l_quantity", "l_discount", "l_tax")))(
    lambda t: rounded(rank.rank_features(lines(t).drop("l_returnflag"), t.spark.createDataFrame(
        [(n, i, c, 0.0) for i, (n, c) in enumerate(PRICE_CLASSES.items()) if n != "l_returnflag"],
        "column string, position int, dtype_class string, unique_pct double"), "l_extendedprice", "regression", "regression_f"), 2))
query("rank_regression_coded")(lambda t: rank.rank_features(
    lines(t), t.spark.createDataFrame([(n, i, c, 0.0) for i, (n, c) in enumerate(PRICE_CLASSES.items())],
                                      "column string, position int, dtype_class string, unique_pct double"),
    "l_extendedprice", "regression", "regression_f"))
query("oversampled_classes", """with c as (select label::double as y, count(*) as n from embeddings group by 1)
      select y, n as given, (select max(n) from c) - n as made from c""")(
    lambda t: smote.oversample(vector_frame(t)).groupBy("y").agg(
        F.count_if(~F.col("synthetic")).alias("given"), F.count_if("synthetic").alias("made")))
query("k_means_clusters")(lambda t: cluster.k_means(vector_frame(t).drop("y")).select("id", "cluster"))
query("hierarchical_clusters")(lambda t: cluster.hierarchical(vector_frame(t).drop("y"), 4).select("id", "cluster"))
query("density_clusters", f"""with recursive near as (select id, neighbour from {PAIRS_SQL} where distance <= 1.16),
      cores as (select id from near group by id having count(*) + 1 >= 4),
      links as (select id, neighbour from near where id in (from cores) and neighbour in (from cores)),
      reach(id, root) as (select id, id from cores union select l.neighbour, r.root from reach r join links l on l.id = r.id),
      roots as (select id, min(root) as root from reach group by id),
      found as (select id, root from roots union all
        select n.id, min(root) from near n join roots on roots.id = n.neighbour where n.id not in (from cores) group by n.id)
      select vec_id as id, coalesce(k, -1)::int as cluster from embeddings
      left join (select id, dense_rank() over (order by root) - 1 as k from found) f on f.id = vec_id""")(
    lambda t: cluster.dbscan(vector_frame(t).drop("y"), 1.16, 4).select("id", "cluster"))
query("elbow_curve")(lambda t: cluster.elbow(vector_frame(t).drop("y")))
query("elbow_facts", """select k::int as k, true as below_total, true as falling, true as within_one_percent from range(2, 11) as g(k)""")(lambda t: _elbow_facts(t))


def _elbow_facts(t):
    """For each k: the inertia lies below that of one cluster, falls with k, and is what the assigned rows add up to."""
    df = vector_frame(t).drop("y")
    found = cluster.lloyd(df, list(range(2, 11)), 3)
    rows = df.select("id", vector_to_array("features").alias("v"))
    total = rows.select(F.inline(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))).groupBy("i").agg(
        (F.var_pop("x") * F.count("x")).alias("s")).agg(F.sum("s")).first()[0]
    out = []
    for k, (centres, inertia) in found.items():
        at = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres]), F.col("cluster"))
        square = F.aggregate(F.zip_with("v", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        again = cluster.assigned(df, centres).select(vector_to_array("features").alias("v"), "cluster").agg(F.sum(square)).first()[0]
        out.append((k, inertia < total, k == 2 or inertia < found[k - 1][1], abs(again - inertia) <= 0.01 * inertia))
    return t.spark.createDataFrame(out, "k int, below_total boolean, falling boolean, within_one_percent boolean")


query("k_means_facts", """select count(*) as rows, 4::bigint as clusters, true as by_nearest_centre from embeddings""")(lambda t: _k_means_facts(t))


def _k_means_facts(t):
    """All rows are in one of four clusters; nearly all are nearest to the mean of their own, as rounds end before the very last."""
    made = cluster.k_means(vector_frame(t).drop("y")).select("id", vector_to_array("features").alias("v"), "cluster").cache()
    means = made.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m")).orderBy("cluster").collect()
    square = lambda m: F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in m]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    nearest = F.array_min(F.array(*[F.struct(square(r["m"]).alias("d"), F.lit(r["cluster"]).alias("cluster")) for r in means]))["cluster"]
    return made.agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("clusters"), (F.avg((nearest == F.col("cluster")).cast("double")) > 0.95).alias("by_nearest_centre"))


def _fitted(t, name, params=None):
    p = modelling.prepare(t.orders.withColumn("big", F.col("o_totalprice") > 150_000), "big", "classification",
                          {"o_totalprice": "numerical", "o_custkey": "numerical", "o_orderpriority": "categorical", "big": "boolean"}, key="o_orderkey")
    return p, modelling.fit_pipe(p, p.rows, name, params)


def learner_facts(t, name, params=None):
    """A class that one column decides: how many rows were scored, whether chances add up to one, whether most are right, and
    whether importances add up to one with the deciding column first, where the learner has any."""
    p, pipe = _fitted(t, name, params)
    pred = pipe.predict(p.rows)
    pairs = pipe.importance()
    trees = hasattr(getattr(pipe.model, "model", None), "featureImportances") or name == "ada_boost"
    leads = not pairs or pairs[0][0] == "o_totalprice"
    whole = not trees or abs(sum(v for _, v in pairs) - 1) < 1e-9
    return pred.agg(F.count("*").alias("rows"), (F.max(F.abs(F.aggregate("prob", F.lit(-1.0), lambda a, b: a + b))) < 1e-9).alias("chances_add_up"),
                    (F.avg((F.col("pred") == F.col("y")).cast("double")) > 0.9).alias("mostly_right"), F.lit(leads).alias("right_column_leads"), F.lit(whole).alias("importances_add_up"))


for _name, _params in (("logistic_regression", None), ("decision_tree", None), ("random_forest", {"n_estimators": 50, "max_depth": 10}), ("gradient_boosting", {"n_estimators": 20}),
                       ("naive_bayes", None), ("linear_svm", {"max_iter": 10}), ("ada_boost", {"n_estimators": 10}), ("nearest_neighbours", None), ("neural_network", None)):
    query(f"facts_{_name}", "select count(*) as rows, true as chances_add_up, true as mostly_right, true as right_column_leads, true as importances_add_up from orders")(
        lambda t, name=_name, params=_params: learner_facts(t, name, params))
query("tuned_ridge", "select 4 as cells, true as in_order, true as spread_known")(lambda t: _tuned(t))


def _tuned(t):
    """The four cells of the grid, best first."""
    rows = t.orders.select(*ORDER_CLASSES)
    found = modelling.tune(rows, "o_totalprice", "regression", "ridge", ORDER_CLASSES, key="o_orderkey").collect()
    scores = [r.score for r in found]
    return t.spark.createDataFrame([(len(found), scores == sorted(scores, reverse=True), all(r.std is not None and r.std >= 0 for r in found))],
                                   "cells int, in_order boolean, spread_known boolean")


query("nomogram", f"""select 'o_custkey' as feature, {r("regr_slope(y, x) * sqrt(var_pop(x))", 2)} as coefficient from {ORDER_SQL}""")(lambda t: _nomogram(t))


def _nomogram(t):
    p = _order_line(t)
    pairs = modelling.fit_pipe(p, p.rows, "linear_regression").nomogram()
    return rounded(t.spark.createDataFrame([(n, float(v)) for n, v in pairs], "feature string, coefficient double"), 2)


query("projection")(lambda t: cluster.projection(vector_frame(t).drop("y")).select("id", F.col("pca").cast("string").alias("pca")))

# --- series --------------------------------------------------------------------------------------------------

DAILY_SQL = "(select event_type as series, date_trunc('day', ts) as date, avg(value) as value from events group by 1, 2)"


def daily(t):
    return forecast.series_points(t.events.withColumn("day", F.date_trunc("day", "ts")), "day", "value", "event_type")


query("series_points", f"select series, strftime(date, '%Y-%m-%d') as date, {r('value')} as value from {DAILY_SQL}")(
    lambda t: rounded(daily(t).withColumn("date", F.date_format("date", "yyyy-MM-dd"))))
query("series_differences", f"""select * from (select series, strftime(date, '%Y-%m-%d') as date,
      {r("value - lag(value) over (partition by series order by date)")} as value from {DAILY_SQL}) where value is not null""")(
    lambda t: rounded(forecast.differences(forecast.numbered_points(daily(t)))
                      .select("series", F.date_format("date", "yyyy-MM-dd").alias("date"), "value")))
query("series_future_dates", f"""select series, k::int as step, strftime(last + to_days((k * gap / 86400)::int), '%Y-%m-%d') as date from (
      select series, max(date) as last, median(gap) as gap from (select series, date,
      epoch(date - lag(date) over (partition by series order by date)) as gap from {DAILY_SQL}) group by 1), range(1, 31) as g(k)""")(
    lambda t: forecast.future_dates(forecast.numbered_points(daily(t))).withColumn("date", F.date_format("date", "yyyy-MM-dd")))
query("series_forecast_walk", f"""with d as (select *, value - lag(value) over (partition by series order by date) as step_up,
        last_value(value) over (partition by series order by date rows between unbounded preceding and unbounded following) as latest from {DAILY_SQL}),
      f as (select series, any_value(latest) as latest, sqrt(avg(step_up * step_up)) as sigma from d group by 1)
      select series, k::int as step, {r("latest")} as forecast, {r("latest - 1.959963984540054 * sigma * sqrt(k)")} as lower,
        {r("latest + 1.959963984540054 * sigma * sqrt(k)")} as upper from f, range(1, 31) as g(k)""")(
    lambda t: rounded(forecast.forecast(forecast.numbered_points(daily(t)), (0, 1, 0)).select("series", "step", "forecast", "lower", "upper")))
query("series_forecast_short", """select l_returnflag || '-' || l_linenumber as series, 'fewer than 10 points' as error from lineitem
      group by 1 having count(distinct date_trunc('year', l_shipdate)) < 10""")(
    lambda t: forecast.forecast(forecast.numbered_points(forecast.series_points(
        t.lineitem.select(F.date_trunc("year", "l_shipdate").alias("year"), "l_quantity", F.concat_ws("-", "l_returnflag", "l_linenumber").alias("s")),
        "year", "l_quantity", "s")), (0, 1, 0), 3).filter("error is not null").select("series", "error"))
query("series_forecast")(lambda t: forecast.forecast(forecast.numbered_points(daily(t))))
query("series_forecast_orders")(lambda t: forecast.forecast(
    forecast.numbered_points(forecast.series_points(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus")), (2, 1, 1), 30))


