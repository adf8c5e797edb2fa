"""The engine's operators as queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import rng
from .operators import cv as cv_ops
from .operators import fit, importance, metrics, predict
from .operators.grow import impurity_of, slot_columns
from .oracle import Spec, draw, impurity, model_sql, q, rows_sql, select, walk_sql, winner
from .plans.prepare import Fit, bags, complete_rows
from .plans.schema import features_of
from .sources.tables import read_table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CUSTOMER = Spec("SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer", "c_custkey", "c_mktsegment", {"c_acctbal": "num", "c_nationkey": "num"}, classes=SEGMENTS)
PART_COLUMNS = "p_partkey, p_size, p_brand, p_type, p_retailprice"
PART = Spec(f"SELECT {PART_COLUMNS} FROM part", "p_partkey", "p_size", {"p_brand": "cat", "p_retailprice": "num", "p_type": "cat"}, "regression", depth=2, n_trees=2, mtry=2)
BINARY = Spec("SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, CASE WHEN c_acctbal + 100 * c_nationkey > 5000 THEN 'high' ELSE 'low' END AS y FROM customer", "c_custkey", "y", {"c_acctbal": "num", "c_mktsegment": "cat", "c_nationkey": "num"}, classes=["high", "low"], n_trees=3, depth=2, mtry=2)


def _only(p: Spec, *features: str, **changes) -> Spec:
    keep = {f: k for f, k in p.features.items() if f in features}
    source = f"SELECT {p.key}, {p.outcome}, {', '.join(keep)}{', ' + changes['weights'] if changes.get('weights') else ''} FROM ({p.source})"
    return replace(p, source=source, features=keep, **changes)


WHOLE = dict(n_trees=1, replace=False, depth=1, mtry=None)


def _frame(spark, sf_dir: str, p: Spec) -> DataFrame:
    """The spec's rows: outcome, features and weights, with the key for the order only."""
    for table in ("customer", "part", "lineitem"):
        if f" FROM {table}" in p.source:
            read_table(spark, f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"src_{table}")
            source = p.source.replace(f" FROM {table}", f" FROM src_{table}")
    return spark.sql(source)


def _train(spark, sf_dir: str, p: Spec) -> DataFrame:
    return _frame(spark, sf_dir, p).select(p.key, p.outcome, *p.features, *([p.weights] if p.weights else []))


def _fit(spark, sf_dir: str, p: Spec, **more) -> tuple[DataFrame, DataFrame]:
    """The model, and the rows it was fitted on. The key numbers the rows and is no feature."""
    rows = _train(spark, sf_dir, p)
    make = fit.fit_classifier if p.is_class else fit.fit_regressor
    return make(rows, p.outcome, **p.kwargs() | {"order_by": [p.key], "features": list(p.features)} | more).cache(), rows


def _nodes(model: DataFrame) -> DataFrame:
    return model.select(
        F.col("tree").cast("long"), "node", F.col("depth").cast("long"), "is_leaf", "split_feature", "split_kind", F.round("threshold", 6).alias("threshold"), F.array_join("cats_left", ",").alias("cats_left"), F.array_join("cats_right", ",").alias("cats_right"),
        "unseen_left", "n_rows", F.round("w_node", 6).alias("w_node"), F.round("impurity", 6).alias("impurity"), F.round("imp_decrease", 6).alias("imp_decrease"),
        F.round("prediction", 6).alias("prediction"), F.round(F.aggregate(F.map_values("class_counts"), F.lit(0.0), lambda a, x: F.greatest(a, x)), 6).alias("largest_count"),
    )


def _nodes_sql(p: Spec) -> str:
    value = "NULL::DOUBLE" if p.is_class else "CASE WHEN is_leaf THEN round(s1 / s0 + (SELECT round(avg(y)) FROM r0), 6) END"
    largest = f"CASE WHEN is_leaf THEN round(greatest({', '.join(p.slots)}), 6) END" if p.is_class else "NULL::DOUBLE"
    return select(model_sql(p), f"SELECT tree::BIGINT AS tree, node, depth::BIGINT AS depth, is_leaf, feature AS split_feature, kind AS split_kind, round(thr, 6) AS threshold, array_to_string(cl, ',') AS cats_left, array_to_string(cr, ',') AS cats_right, ul AS unseen_left, n AS n_rows, round(wn, 6) AS w_node, round(imp, 6) AS impurity, round(gain, 6) AS imp_decrease, {value} AS prediction, {largest} AS largest_count FROM model")


QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _add(name: str, run: Callable, sql: str | None) -> None:
    QUERIES[name] = (run, sql)


def _node_query(name: str, p: Spec) -> None:
    _add(name, lambda spark, d, p=p: _nodes(_fit(spark, d, p)[0]), _nodes_sql(p))


# ---- preparation -----------------------------------------------------------------------------------------------------
_add(
    "column_kinds",
    lambda spark, d: spark.createDataFrame(features_of(_train(spark, d, PART).schema, PART.key), "feature string, kind string"),
    "SELECT * FROM (VALUES ('p_brand', 'cat'), ('p_retailprice', 'num'), ('p_size', 'num'), ('p_type', 'cat')) t(feature, kind)",
)
_add("complete_rows", lambda spark, d: complete_rows(read_table(spark, f"{d}/customer.parquet")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM customer WHERE COLUMNS(*) IS NOT NULL")


def _bags(spark, d: str, trees: int, frac: float, with_replacement: bool) -> DataFrame:
    n = read_table(spark, f"{d}/customer.parquet").count()
    return bags(spark, list(range(1, trees + 1)), 42, n, frac, with_replacement).select(F.col("tree").cast("long"), "i", "n_drawn")


for _name, _rep, _frac in (("bag_replace", True, 1.0), ("bag_subset", False, 0.4)):
    _p = replace(CUSTOMER, n_trees=3, replace=_rep, frac=_frac)
    _add(_name, lambda spark, d, r=_rep, f=_frac: _bags(spark, d, 3, f, r), select(rows_sql(_p), "SELECT tree::BIGINT AS tree, i, c::BIGINT AS n_drawn FROM b"))
_add(
    "bag_632",
    lambda spark, d: _bags(spark, d, 3, 1.0, True).groupBy("tree").agg(F.count("*").alias("n_distinct"), F.sum("n_drawn").alias("n_drawn")),
    select(rows_sql(replace(CUSTOMER, n_trees=3)), "SELECT tree::BIGINT AS tree, count(*) AS n_distinct, sum(c)::BIGINT AS n_drawn FROM b GROUP BY tree"),
)


def _lottery(spark, d: str) -> DataFrame:
    grid = spark.range(1, 5).select(F.col("id").alias("tree")).select("tree", F.explode(F.array(*(F.lit(x).cast("long") for x in range(1, 8)))).alias("node"))
    each = grid.select("tree", "node", F.explode(F.array(*map(F.lit, sorted(PART.features)))).alias("feature"))
    key = rng.rank_key(F.concat_ws(":", F.lit("42"), "tree", "node", "feature"))
    drawn = each.groupBy("tree", "node").agg(F.sort_array(F.collect_list(F.struct(key.alias("r"), "feature"))).alias("x"))
    return drawn.select("tree", "node", F.array_join(F.transform("x", lambda x: x.feature), ",").alias("drawn"))


_add("mtry_lottery", _lottery, f"SELECT tree, node, string_agg(feature, ',' ORDER BY {draw(q('42'), 'tree', 'node', 'feature')}) AS drawn FROM range(1, 5) t(tree), range(1, 8) n(node), (VALUES ('p_brand'), ('p_retailprice'), ('p_type')) f(feature) GROUP BY tree, node")


def _impurity(spark, d: str, p: Spec) -> DataFrame:
    rows = _train(spark, d, p).select(F.col(p.outcome).cast("string" if p.is_class else "double").alias("y"), F.lit(1.0).alias("w"))
    f = Fit(outcome="y", family=p.family, caller="root_impurity", criterion=p.criterion, classes=p.classes or None)
    sums = rows.agg(*(F.sum(s).alias(f"s{i}") for i, s in enumerate(slot_columns(f))))
    return sums.select(F.round(impurity_of([F.col(c) for c in sums.columns], p.criterion), 6).alias("impurity"))


for _name, _p in (("root_impurity_gini", CUSTOMER), ("root_impurity_entropy", replace(CUSTOMER, criterion="entropy")), ("root_impurity_mse", replace(PART, criterion="mse"))):
    _one = [f"sum(CASE WHEN y = {q(c)} THEN 1.0 ELSE 0.0 END)::DOUBLE AS s{i}" for i, c in enumerate(_p.classes)] if _p.is_class else ["count(*)::DOUBLE AS s0", "sum(y)::DOUBLE AS s1", "sum(y * y)::DOUBLE AS s2"]
    _add(_name, lambda spark, d, p=_p: _impurity(spark, d, p), f"SELECT round({impurity(_p.slots, _p)}, 6) AS impurity FROM (SELECT {', '.join(_one)} FROM (SELECT {_p.outcome} AS y FROM ({_p.source})))")

# ---- splits and nodes ------------------------------------------------------------------------------------------------
_node_query("best_split_numeric_class", replace(CUSTOMER, **WHOLE))
_node_query("best_split_numeric_reg", _only(PART, "p_retailprice", **WHOLE))
_node_query("best_split_cat_reg", _only(PART, "p_brand", **WHOLE))
_node_query("best_split_cat_binary", _only(BINARY, "c_mktsegment", **WHOLE))
MULTI = replace(CUSTOMER, source="SELECT c_custkey, c_mktsegment, 'n' || c_nationkey AS nation FROM customer", features={"nation": "cat"}, n_trees=1, replace=False, depth=1)
_node_query("best_split_cat_multi", MULTI)
_node_query("random_split_numeric", replace(CUSTOMER, n_trees=2, splitter="random", depth=1))
_node_query("random_split_cat", _only(PART, "p_brand", "p_type", n_trees=2, splitter="random", depth=1, mtry=2))
_node_query("stump_nodes", replace(BINARY, n_trees=1, depth=1))
_node_query("depth2_nodes", replace(BINARY, n_trees=1, depth=2))
_node_query("forest_nodes_depth3", replace(BINARY, n_trees=2, depth=3))
_node_query("forest_reg_nodes", PART)
_node_query("entropy_nodes", replace(BINARY, n_trees=1, depth=1, criterion="entropy"))
_node_query("extra_trees_nodes", replace(BINARY, n_trees=2, depth=2, splitter="random"))
_node_query("subset_bag_nodes", replace(BINARY, n_trees=2, depth=1, replace=False, frac=0.5))
_node_query("min_leaf_nodes", replace(BINARY, n_trees=1, depth=2, min_leaf=200))
WEIGHTED = replace(BINARY, source=BINARY.source.replace(" AS y FROM", " AS y, 1 + c_custkey % 3 AS wt FROM"), weights="wt", n_trees=1, depth=1)
_node_query("weighted_stump", WEIGHTED)
_node_query("deep_forest_nodes", replace(BINARY, n_trees=4, depth=6))
_node_query("deep_reg_forest_nodes", replace(PART, n_trees=2, depth=5))
_node_query("balanced_stump", replace(BINARY, balanced=True, n_trees=1, depth=1, replace=False))

# ---- predictions -----------------------------------------------------------------------------------------------------


def _new(p: Spec, source: str) -> str:
    """SQL of rows to score: id (the key) and the features."""
    cells = ", ".join(f"CAST({f} AS {'DOUBLE' if k == 'num' else 'VARCHAR'}) AS {f}" for f, k in p.features.items())
    return f"SELECT {p.key} AS id, {cells} FROM ({source})"


def _score(spark, d: str, p: Spec, new: Spec | None = None, **more) -> DataFrame:
    model, _ = _fit(spark, d, p)
    rows = _frame(spark, d, new or p).select(F.col(p.key).cast("long").alias("id"), *p.features)
    make = predict.predict_classifier if p.is_class else predict.predict_regressor
    out = make(model, rows, **more)
    if not p.is_class:
        return out.select("id", F.round("prediction", 6).alias("prediction"))
    return out.select("id", "pred", *(F.round(F.element_at("probs", F.lit(c)), 6).alias(f"p_{i}") for i, c in enumerate(p.classes)))


def _score_sql(p: Spec, new: str | None = None, na: str = "null", n_trees: int | None = None) -> str:
    rows = _new(p, new or p.source)
    ctes = model_sql(p) + walk_sql(p, rows, n_trees)
    full = " AND ".join(f"q.{f} IS NOT NULL" for f in p.features) if na == "null" else "true"
    if not p.is_class:
        return select(ctes, f"SELECT q.id::BIGINT AS id, round(CASE WHEN {full} THEN avg(l.value) END, 6) AS prediction FROM q0 q LEFT JOIN landed l USING (id) GROUP BY q.id, {', '.join(f'q.{f}' for f in p.features)}")
    mean = ", ".join(f"avg(p{k}) AS p_{k}" for k in range(len(p.classes)))
    return select(ctes, f"SELECT q.id::BIGINT AS id, {winner(p, [f'p_{k}' for k in range(len(p.classes))])} AS pred, {', '.join(f'round(p_{k}, 6) AS p_{k}' for k in range(len(p.classes)))} FROM q0 q LEFT JOIN (SELECT id, {mean} FROM landed GROUP BY id) l USING (id)")


GAPS = "SELECT p_partkey, p_size, p_brand, p_type, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS p_retailprice FROM part"
_gaps = replace(PART, source=GAPS)
_add("predict_reg", lambda spark, d: _score(spark, d, PART), _score_sql(PART))
_add("predict_class_flat", lambda spark, d: _score(spark, d, BINARY), _score_sql(BINARY))
_add("predict_null_rows", lambda spark, d: _score(spark, d, PART, _gaps), _score_sql(PART, GAPS))
_add("predict_skip_tree", lambda spark, d: _score(spark, d, PART, _gaps, na_action="skip_tree"), _score_sql(PART, GAPS, "skip"))
_add("predict_tree_cap", lambda spark, d: _score(spark, d, PART, n_trees=1), _score_sql(PART, n_trees=1))
UNSEEN = "SELECT c_custkey, c_acctbal, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEVERSEEN' ELSE c_mktsegment END AS c_mktsegment, 'low' AS y FROM customer"
_seg = _only(BINARY, "c_mktsegment", "c_nationkey", n_trees=2)
_add("unseen_level_route", lambda spark, d: _score(spark, d, _seg, replace(_seg, source=UNSEEN)), _score_sql(_seg, UNSEEN))


def _per_tree(spark, d: str) -> DataFrame:
    model, rows = _fit(spark, d, PART)
    out = predict.predict_trees_regressor(model, rows, order_by=[PART.key])
    return out.select(F.col("__rf_rid__").alias("rid"), F.col("tree").cast("long"), F.round("prediction", 6).alias("prediction"))


_add("predict_trees", _per_tree, select(model_sql(PART) + walk_sql(PART, f"SELECT i AS id, {', '.join(PART.features)} FROM r"), "SELECT id AS rid, tree::BIGINT AS tree, round(value, 6) AS prediction FROM landed"))



def _per_tree_class(spark, d: str) -> DataFrame:
    model, rows = _fit(spark, d, BINARY)
    out = predict.predict_trees_classifier(model, rows, order_by=[BINARY.key])
    return out.select(F.col("__rf_rid__").alias("rid"), F.col("tree").cast("long"), "pred", F.round(F.element_at("probs", F.lit(BINARY.classes[0])), 6).alias("p_0"))


_add("predict_trees_class", _per_tree_class, select(model_sql(BINARY) + walk_sql(BINARY, f"SELECT i AS id, {', '.join(BINARY.features)} FROM r"), f"SELECT id AS rid, tree::BIGINT AS tree, {winner(BINARY, ['p0', 'p1'])} AS pred, round(p0, 6) AS p_0 FROM landed"))

# ---- metrics, in and out of bag --------------------------------------------------------------------------------------
_REG = "SELECT count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(avg(abs(y - yhat)), 6) AS mae, round(1 - sum((y - yhat) * (y - yhat)) / sum((y - m) * (y - m)), 6) AS r2"
_CLASS = "SELECT count(*) AS n, round(avg((pred = y)::INT), 6) AS accuracy, round(-avg(ln(least(greatest(pt, 1e-15), 1 - 1e-15))), 6) AS log_loss, round(avg(br), 6) AS brier, round((sum(CASE WHEN pos = 1 THEN rk END) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (count(*) - sum(pos))), 6) AS auc"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _metric_rows(p: Spec) -> str:
    """SQL of the rows that metrics are taken of, from landed and r0."""
    if not p.is_class:
        return "SELECT t.y, l.yhat, avg(t.y) OVER () AS m FROM r0 t JOIN (SELECT id, avg(value) AS yhat FROM landed GROUP BY id) l ON l.id = t.i"
    k = range(len(p.classes))
    mean = ", ".join(f"avg(p{j}) AS p_{j}" for j in k)
    pt = "CASE t.y " + " ".join(f"WHEN {q(c)} THEN p_{j}" for j, c in enumerate(p.classes)) + " END"
    br = "0.5 * (" + " + ".join(f"power((t.y = {q(c)})::INT - p_{j}, 2)" for j, c in enumerate(p.classes)) + ")"
    return f"SELECT *, avg(rn) OVER (PARTITION BY pp) AS rk FROM (SELECT t.y, {winner(p, [f'p_{j}' for j in k])} AS pred, {pt} AS pt, {br} AS br, p_1 AS pp, (t.y = {q(p.classes[1])})::INT AS pos, row_number() OVER (ORDER BY p_1) AS rn FROM r0 t JOIN (SELECT id, {mean} FROM landed GROUP BY id) l ON l.id = t.i)"


def _ids(p: Spec) -> str:
    return f"SELECT i AS id, {', '.join(p.features)} FROM r"


OOB = "SELECT i AS id, tree FROM r, range(1, {} + 1) t(tree) WHERE (tree, i) NOT IN (SELECT (tree, i) FROM b)"


def _metric(name: str, p: Spec, oob: bool) -> None:
    ctes = model_sql(p) + walk_sql(p, _ids(p), None, OOB.format(p.n_trees) if oob else None)
    final = (_CLASS if p.is_class else _REG) + (", (SELECT count(*) FROM r0) - count(*) AS n_excluded" if oob else "") + f" FROM ({_metric_rows(p)})"

    def run(spark, d: str) -> DataFrame:
        model, rows = _fit(spark, d, p)
        calls = {(True, False): metrics.evaluate_classifier, (False, False): metrics.evaluate_regressor, (True, True): metrics.oob_classifier, (False, True): metrics.oob_regressor}
        return _rounded(calls[(p.is_class, oob)](model, rows, p.outcome, **({"order_by": [p.key]} if oob else {})))

    _add(name, run, select(ctes, final))


_metric("evaluate_reg", PART, False)
_metric("evaluate_class_auc", BINARY, False)
_metric("oob_reg", PART, True)
_metric("oob_class", BINARY, True)


def _several_sql(p: Spec) -> str:
    """Metrics of more than two classes: squared gaps of all classes, no area."""
    k = range(len(p.classes))
    mean = ", ".join(f"avg(p{j}) AS p_{j}" for j in k)
    pt = "CASE t.y " + " ".join(f"WHEN {q(c)} THEN p_{j}" for j, c in enumerate(p.classes)) + " END"
    gaps = " + ".join(f"power((t.y = {q(c)})::INT - p_{j}, 2)" for j, c in enumerate(p.classes))
    rows = f"SELECT t.y, {winner(p, [f'p_{j}' for j in k])} AS pred, {pt} AS pt, {gaps} AS br FROM r0 t JOIN (SELECT id, {mean} FROM landed GROUP BY id) l ON l.id = t.i"
    return select(model_sql(p) + walk_sql(p, _ids(p)), f"SELECT count(*) AS n, round(avg((pred = y)::INT), 6) AS accuracy, round(-avg(ln(least(greatest(pt, 1e-15), 1 - 1e-15))), 6) AS log_loss, round(avg(br), 6) AS brier, NULL::DOUBLE AS auc FROM ({rows})")


def _several(spark, d: str) -> DataFrame:
    model, rows = _fit(spark, d, SEVERAL)
    return _rounded(metrics.evaluate_classifier(model, rows, SEVERAL.outcome))


SEVERAL = replace(CUSTOMER, n_trees=3, depth=2)
_add("evaluate_class_several", _several, _several_sql(SEVERAL))


def _oob_predictions(spark, d: str, p: Spec) -> DataFrame:
    model, rows = _fit(spark, d, p)
    if not p.is_class:
        out = predict.oob_predict_regressor(model, rows, order_by=[p.key])
        return out.groupBy(F.col(p.outcome).cast("long").alias("y")).agg(F.count("prediction").alias("n"), F.count("*").alias("n_all"), F.round(F.sum("prediction"), 4).alias("total"))
    out = predict.oob_predict_classifier(model, rows, order_by=[p.key])
    return out.groupBy(F.col(p.outcome).alias("y"), "pred").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("probs", F.lit(p.classes[0]))), 4).alias("total"))


_add("oob_predict_reg", lambda spark, d: _oob_predictions(spark, d, PART), select(model_sql(PART) + walk_sql(PART, _ids(PART), None, OOB.format(2)), "SELECT t.y::BIGINT AS y, count(l.v) AS n, count(*) AS n_all, round(sum(l.v), 4) AS total FROM r0 t LEFT JOIN (SELECT id, avg(value) AS v FROM landed GROUP BY id) l ON l.id = t.i GROUP BY t.y"))
_add(
    "oob_predict_class",
    lambda spark, d: _oob_predictions(spark, d, BINARY),
    select(model_sql(BINARY) + walk_sql(BINARY, _ids(BINARY), None, OOB.format(3)), f"SELECT y, pred, count(*) AS n, round(sum(p_0), 4) AS total FROM (SELECT t.y, l.p_0, {winner(BINARY, ['l.p_0', 'l.p_1'])} AS pred FROM r0 t LEFT JOIN (SELECT id, avg(p0) AS p_0, avg(p1) AS p_1 FROM landed GROUP BY id) l ON l.id = t.i) GROUP BY y, pred"),
)

# ---- importance, summary, batches ------------------------------------------------------------------------------------


def _mdi_sql(p: Spec) -> str:
    every = ", ".join(f"({q(f)})" for f in p.features)
    return select(
        model_sql(p)
        + [
            "raw AS (SELECT m.tree, m.feature, sum(m.gain / z.wn) AS raw FROM model m JOIN model z ON z.tree = m.tree AND z.node = 1 WHERE NOT m.is_leaf GROUP BY ALL)",
            f"mean AS (SELECT feature, sum(raw / tot) / {p.n_trees} AS x FROM (SELECT *, sum(raw) OVER (PARTITION BY tree) AS tot FROM raw) WHERE tot > 0 GROUP BY feature)",
        ],
        f"SELECT f.feature, round(coalesce(x, 0) / (SELECT sum(x) FROM mean), 6) AS importance FROM (VALUES {every}) f(feature) LEFT JOIN mean USING (feature)",
    )


_add("mdi_importance", lambda spark, d: _rounded(importance.importance(_fit(spark, d, BINARY)[0])), _mdi_sql(BINARY))
_add(
    "forest_summary",
    lambda spark, d: importance.summary(_fit(spark, d, BINARY)[0]).select("family", F.col("n_trees").cast("long"), "n_nodes", "n_leaves", F.col("max_depth_reached").cast("long"), F.round("mean_leaf_depth", 6).alias("mean_leaf_depth"), "depth_cap_hit", F.col("n_features").cast("long"), F.col("mtry").cast("long"), "n_train"),
    select(model_sql(BINARY), f"SELECT 'classification' AS family, 3::BIGINT AS n_trees, count(*) AS n_nodes, count(*) FILTER (is_leaf) AS n_leaves, max(depth)::BIGINT AS max_depth_reached, round(avg(depth) FILTER (is_leaf), 6) AS mean_leaf_depth, bool_or(is_leaf AND depth = {BINARY.depth} AND imp > 2.220446049250313e-16) AS depth_cap_hit, 3::BIGINT AS n_features, 2::BIGINT AS mtry, (SELECT count(*) FROM r0) AS n_train FROM model"),
)


def _union(spark, d: str) -> DataFrame:
    args = BINARY.kwargs() | {"order_by": [BINARY.key], "features": list(BINARY.features)}
    return _nodes(fit.fit_batched(_train(spark, d, BINARY), BINARY.outcome, BINARY.family, batch_size=2, **args))


_add("batch_union", _union, _nodes_sql(BINARY))
_add("batch_ranges", lambda spark, d: spark.createDataFrame(fit.batch_ranges(23, 5), "tree_from long, tree_to long"), "SELECT k AS tree_from, least(k + 4, 23) AS tree_to FROM range(1, 24, 5) t(k)")


def _permutation(spark, d: str) -> DataFrame:
    model, rows = _fit(spark, d, PART)
    return _rounded(importance.permutation_importance(model, rows, PART.outcome, n_repeats=2, seed=7, order_by=[PART.key]))


def _permutation_sql(p: Spec, repeats: int, seed: int) -> str:
    """Each feature's rows with that feature's value taken from the row that the shuffle puts there."""
    each = []
    for f in p.features:
        for rep in range(1, repeats + 1):
            others = ", ".join(f"s.{f}" if g == f else f"a.{g}" for g in p.features)
            each.append(f"SELECT {q(f)} || ':{rep}:' || a.i AS id, {q(f)} AS pf, {rep} AS rep, a.i AS i, {others} FROM r a JOIN (SELECT {f}, row_number() OVER (ORDER BY {draw(q(f'{seed}:P'), q(f), str(rep), 'i')}, i) AS at FROM r) s ON s.at = a.i")
    each.append(f"SELECT 'base:' || i AS id, NULL AS pf, NULL AS rep, i, {', '.join(p.features)} FROM r")
    ctes = model_sql(p) + walk_sql(p, " UNION ALL ".join(each))
    ctes.append(_accuracy(p) if p.is_class else "sc AS (SELECT q.pf, q.rep, 1 - sum(power(t.y - l.v, 2)) / (SELECT sum(power(y - (SELECT avg(y) FROM r0), 2)) FROM r0) AS score FROM q0 q JOIN (SELECT id, avg(value) AS v FROM landed GROUP BY id) l USING (id) JOIN r0 t ON t.i = q.i GROUP BY q.pf, q.rep)")
    return select(ctes, "SELECT pf AS feature, round(avg(b - score), 6) AS importance, round(stddev_pop(b - score), 6) AS importance_std FROM (SELECT *, (SELECT score FROM sc WHERE pf IS NULL) AS b FROM sc WHERE pf IS NOT NULL) GROUP BY pf")


def _permutation_class(spark, d: str) -> DataFrame:
    model, rows = _fit(spark, d, BINARY)
    return _rounded(importance.permutation_importance(model, rows, BINARY.outcome, n_repeats=2, seed=7, order_by=[BINARY.key]))


def _accuracy(p: Spec) -> str:
    """The score of each shuffle of a classification forest."""
    mean = ", ".join(f"avg(p{j}) AS p_{j}" for j in range(len(p.classes)))
    return f"sc AS (SELECT q.pf, q.rep, avg(({winner(p, [f'l.p_{j}' for j in range(len(p.classes))])} = t.y)::INT) AS score FROM q0 q JOIN (SELECT id, {mean} FROM landed GROUP BY id) l USING (id) JOIN r0 t ON t.i = q.i GROUP BY q.pf, q.rep)"


_add("permutation_class", _permutation_class, _permutation_sql(BINARY, 2, 7))
_add("permutation_importance", _permutation, _permutation_sql(PART, 2, 7))


def _quantiles(spark, d: str) -> DataFrame:
    model, _ = _fit(spark, d, PART)
    rows = _train(spark, d, PART)
    out = predict.predict_quantiles(model, rows, PART.outcome, [0.1, 0.5, 0.9])
    return out.select(F.col(PART.key).cast("long").alias("id"), *(F.element_at("quantile_pred", F.lit(x)).alias(f"q{int(100 * x)}") for x in (0.1, 0.5, 0.9)))


_levels = ", ".join(f"min(y) FILTER (cw + 1e-12 >= {x}) AS q{int(100 * x)}" for x in (0.1, 0.5, 0.9))
_add(
    "quantile_forest",
    _quantiles,
    select(
        model_sql(PART)
        + walk_sql(PART, f"SELECT p_partkey AS id, p_size::DOUBLE AS y, {', '.join(PART.features)} FROM part")
        + [
            "mem AS MATERIALIZED (SELECT tree, node, y, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY tree, node) AS share FROM landed JOIN q0 USING (id) GROUP BY tree, node, y)",
            "tx AS (SELECT id, count(*) AS t FROM landed GROUP BY id)",
            "wt AS (SELECT l.id, m.y, sum(m.share) / any_value(tx.t) AS w FROM landed l JOIN mem m USING (tree, node) JOIN tx ON tx.id = l.id GROUP BY l.id, m.y)",
            "cum AS (SELECT id, y, sum(w) OVER (PARTITION BY id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM wt)",
        ],
        f"SELECT id::BIGINT AS id, {_levels} FROM cum GROUP BY id",
    ),
)


def _quantiles_new(spark, d: str) -> DataFrame:
    model, rows = _fit(spark, d, PART)
    new = _frame(spark, d, replace(PART, source=OTHERS)).select(F.col(PART.key).cast("long").alias("id"), *PART.features)
    out = predict.predict_quantiles(model, rows, PART.outcome, [0.1, 0.5, 0.9], newdata=new)
    return out.select("id", *(F.element_at("quantile_pred", F.lit(x)).alias(f"q{int(100 * x)}") for x in (0.1, 0.5, 0.9)))


#: Parts that are none of the table's: other prices, and brands of other parts.
OTHERS = "SELECT p_partkey, p_size, 'Brand#' || (11 + p_partkey % 40) AS p_brand, p_type, p_retailprice + 7 AS p_retailprice FROM part"
_both = f"SELECT p_partkey AS id, p_size::DOUBLE AS y, {', '.join(PART.features)} FROM part UNION ALL SELECT -p_partkey - 1 AS id, NULL::DOUBLE AS y, {', '.join(PART.features)} FROM ({OTHERS})"
_add(
    "quantile_newdata",
    _quantiles_new,
    select(
        model_sql(PART)
        + walk_sql(PART, _both)
        + [
            "mem AS MATERIALIZED (SELECT tree, node, y, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY tree, node) AS share FROM landed JOIN q0 USING (id) WHERE id >= 0 GROUP BY tree, node, y)",
            "tx AS (SELECT id, count(*) AS t FROM landed GROUP BY id)",
            "wt AS (SELECT l.id, m.y, sum(m.share) / any_value(tx.t) AS w FROM landed l JOIN mem m USING (tree, node) JOIN tx ON tx.id = l.id WHERE l.id < 0 GROUP BY l.id, m.y)",
            "cum AS (SELECT id, y, sum(w) OVER (PARTITION BY id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM wt)",
        ],
        f"SELECT (-id - 1)::BIGINT AS id, {_levels} FROM cum GROUP BY id",
    ),
)


def _cv(spark, d: str, sweep: str) -> DataFrame:
    rows = _train(spark, d, BINARY).orderBy(BINARY.key).drop(BINARY.key)
    if sweep == "mtry":
        return cv_ops.cv_mtry(rows, BINARY.outcome, BINARY.family, [1, 2], k=2, n_trees=1, max_depth=1, seed=5).select(F.col("mtry").cast("long"), F.round("cv_error", 6).alias("cv_error"))
    return cv_ops.cv_depth(rows, BINARY.outcome, BINARY.family, [1, 2], mtry=2, k=2, n_trees=1, seed=5).select(F.col("max_depth").cast("long"), F.round("cv_error", 6).alias("cv_error"))


def _cv_sql(p: Spec, grid: list[tuple[int, int, int]], k: int, seed: int, name: str) -> str:
    """grid: the reported value, mtry and depth. One tree for each value and fold, each a forest of its own in SQL."""
    arms = []
    for gi, (value, mtry, depth) in enumerate(grid):
        for held in range(k):
            g = gi * k + held
            numbered = f"(SELECT *, row_number() OVER (ORDER BY {p.key}) - 1 AS __at FROM ({p.source}))"
            one = replace(p, source=f"SELECT * FROM {numbered} WHERE __at % {k} != {held}", mtry=mtry, depth=depth, n_trees=1, seed=f"{seed}:cv:{g}")
            rows = f"SELECT __at AS id, CAST({p.outcome} AS VARCHAR) AS y, {', '.join(f'CAST({f} AS ' + ('DOUBLE' if kd == 'num' else 'VARCHAR') + f') AS {f}' for f, kd in p.features.items())} FROM {numbered} WHERE __at % {k} = {held}"
            wrong = f"({winner(one, ['l.p0', 'l.p1'])} != q.y)::INT" if p.is_class else "power(q.y::DOUBLE - l.value, 2)"
            arms.append("SELECT * FROM (" + select(model_sql(one) + walk_sql(one, rows), f"SELECT {value} AS v, {wrong} AS wrong FROM q0 q JOIN landed l USING (id)") + ")")
    return f"SELECT v::BIGINT AS {name}, round(avg(wrong), 6) AS cv_error FROM (" + " UNION ALL ".join(arms) + ") GROUP BY v"


def _cv_reg(spark, d: str) -> DataFrame:
    rows = _train(spark, d, PART).orderBy(PART.key).drop(PART.key)
    return cv_ops.cv_depth(rows, PART.outcome, PART.family, [1, 2], mtry=2, k=2, n_trees=1, seed=5).select(F.col("max_depth").cast("long"), F.round("cv_error", 6).alias("cv_error"))


_add("cv_reg", _cv_reg, _cv_sql(PART, [(1, 2, 1), (2, 2, 2)], 2, 5, "max_depth"))
_add("cv_mtry", lambda spark, d: _cv(spark, d, "mtry"), _cv_sql(BINARY, [(1, 1, 1), (2, 2, 1)], 2, 5, "mtry"))
_add("cv_depth", lambda spark, d: _cv(spark, d, "depth"), _cv_sql(BINARY, [(1, 2, 1), (2, 2, 2)], 2, 5, "max_depth"))
_add("lineitem_stump", lambda spark, d: _nodes(_fit(spark, d, LINEITEM)[0]), None)
LINEITEM = Spec("SELECT l_orderkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag FROM lineitem", "l_extendedprice", "l_quantity", {"l_discount": "num", "l_returnflag": "cat", "l_tax": "num"}, "regression", n_trees=1, depth=2, replace=False, mtry=3)
QUERIES["lineitem_stump"] = (QUERIES["lineitem_stump"][0], _nodes_sql(LINEITEM))
