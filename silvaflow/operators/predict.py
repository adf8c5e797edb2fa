"""Predictions: of a forest, of its trees, out of bag, and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prepare import check_name, number, ordinals, typed_cells
from ..plans.rules import fail
from ..sources.tables import resolve
from .descend import RID, Model, cells, check_scoring, landed, open_model, out_of_bag
from .score import fits, with_scores


def class_shares(m: Model) -> list[Column]:
    """For each class the share of its weight in the leaf a row reached."""
    total = F.aggregate(F.map_values("class_counts"), F.lit(0.0), lambda a, x: a + x)
    return [F.try_divide(F.element_at("class_counts", F.lit(c)), total) for c in m.classes]


def voted(walk: DataFrame, m: Model, by: list[str]) -> DataFrame:
    """by, and prediction, or pred and p_0..: the mean over the trees a row reached a leaf of."""
    if m.meta.family == "regression":
        return walk.groupBy(*by).agg(F.avg("prediction").alias("prediction"))
    out = walk.groupBy(*by).agg(*(F.avg(s).alias(f"p_{i}") for i, s in enumerate(class_shares(m))))
    return out.withColumn("pred", winner(m.classes, [F.col(f"p_{i}") for i in range(len(m.classes))]))


def winner(classes: list[str], p: list[Column]) -> Column:
    """The class of the largest share; of equals the first."""
    return F.array_min(F.array(*(F.struct((-x).alias("p"), F.lit(c).alias("c")) for c, x in zip(classes, p, strict=True)))).c


def probabilities(m: Model) -> Column:
    return F.when(F.col("p_0").isNotNull(), F.map_from_arrays(F.array(*map(F.lit, m.classes)), F.array(*(F.col(f"p_{i}") for i in range(len(m.classes))))))


def _attach(df: DataFrame, found: DataFrame, m: Model) -> DataFrame:
    out = df.join(found, RID, "left")
    if m.meta.family == "regression":
        return out.select(*(F.col(f"`{c}`") for c in df.columns if c != RID), "prediction")
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != RID), "pred", probabilities(m).alias("probs"))


def _predict(model, table, family: str, caller: str, na_action: str, n_trees: int | None) -> DataFrame:
    check_name(caller, table)
    check_name(caller, model)
    m, df = open_model(model, caller, family), resolve(table)
    check_scoring(caller, df, na_action, n_trees, ("prediction",) if family == "regression" else ("pred", "probs"))
    if fits(m):
        num, cat = typed_cells(m.features, df)
        out = with_scores(df, num, cat, m, na_action, n_trees, "__s")
        own = [F.col(f"`{c}`") for c in df.columns]
        if family == "regression":
            return out.select(*own, F.col("__s")[0].alias("prediction"))
        shares = [F.col("__s")[i] for i in range(len(m.classes))]
        probs = F.when(F.col("__s").isNotNull(), F.map_from_arrays(F.array(*map(F.lit, m.classes)), F.col("__s")))
        return out.select(*own, F.when(F.col("__s").isNotNull(), winner(m.classes, shares)).alias("pred"), probs.alias("probs"))
    whole = ordinals(df, None, RID)  # a model too large to send around: joined level by level
    return _attach(whole, voted(landed(cells(whole, m, [RID], na_action), m, n_trees), m, [RID]), m)


def predict_regressor(model, table, na_action: str = "null", n_trees: int | None = None) -> DataFrame:
    """The columns of table and prediction, the mean over the trees; null where a row lacks a feature (na_action 'null') or no
    tree can score it ('skip_tree')."""
    return _predict(model, table, "regression", "predict_regressor", na_action, n_trees)


def predict_classifier(model, table, na_action: str = "null", n_trees: int | None = None) -> DataFrame:
    """The columns of table, pred and probs (map of every class to its share of the soft vote)."""
    return _predict(model, table, "classification", "predict_classifier", na_action, n_trees)


def _trees(model, table, family: str, caller: str, na_action: str, n_trees: int | None, order_by: list[str] | None) -> DataFrame:
    check_name(caller, table)
    m, df = open_model(model, caller, family), resolve(table)
    check_scoring(caller, df, na_action, n_trees)
    walk = landed(cells(ordinals(df, order_by, RID), m, [RID], na_action), m, n_trees)
    if family == "regression":
        return walk.select(RID, "tree", "prediction")
    shares = class_shares(m)
    out = walk.select(RID, "tree", *(s.alias(f"p_{i}") for i, s in enumerate(shares)))
    return out.select(RID, "tree", winner(m.classes, [F.col(f"p_{i}") for i in range(len(shares))]).alias("pred"), probabilities(m).alias("probs"))


def predict_trees_regressor(model, table, na_action: str = "null", n_trees: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """__rf_rid__ (1.. in the order of order_by), tree and prediction of each row and tree."""
    return _trees(model, table, "regression", "predict_trees_regressor", na_action, n_trees, order_by)


def predict_trees_classifier(model, table, na_action: str = "null", n_trees: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    return _trees(model, table, "classification", "predict_trees_classifier", na_action, n_trees, order_by)


def _oob(model, table, family: str, caller: str, order_by: list[str] | None) -> DataFrame:
    check_name(caller, table)
    m, df = open_model(model, caller, family), resolve(table)
    check_scoring(caller, df, "null", None, ("prediction",) if family == "regression" else ("pred", "probs"))
    full, starts = out_of_bag(df, m, caller, order_by)
    scored = _attach(full, voted(landed(None, m, None, starts), m, [RID]), m)
    partial = df.filter(~_complete(df))
    nothing = [F.lit(None).cast("double").alias("prediction")] if family == "regression" else [F.lit(None).cast("string").alias("pred"), F.lit(None).cast("map<string,double>").alias("probs")]
    return scored.unionByName(partial.select("*", *nothing))


def _complete(df: DataFrame) -> Column:
    return F.forall(F.array(*(F.col(f"`{c}`").isNotNull() for c in df.columns)), lambda x: x)


def oob_predict_regressor(model, table, order_by: list[str] | None = None) -> DataFrame:
    """The training table with the prediction of the trees that did not bag a row; null if all did."""
    return _oob(model, table, "regression", "oob_predict_regressor", order_by)


def oob_predict_classifier(model, table, order_by: list[str] | None = None) -> DataFrame:
    return _oob(model, table, "classification", "oob_predict_classifier", order_by)


def predict_quantiles(model, table, outcome: str, quantiles: list[float], newdata=None, na_action: str = "null", n_trees: int | None = None) -> DataFrame:
    """The columns of newdata (or of table) and quantile_pred, a map of each level to its value: responses of the reference
    rows in table, weighted by shared leaves (1 / rows in the leaf, a mean over the trees that scored the new row); the value
    is the smallest response with a cumulative weight of the level or more."""
    caller = "predict_quantiles"
    for t in (model, table, newdata):
        check_name(caller, t)
    m, ref = open_model(model, caller), resolve(table)
    new = resolve(newdata) if newdata is not None else ref
    check_scoring(caller, ref, na_action, n_trees)
    check_scoring(caller, new, na_action, n_trees, ("quantile_pred",))
    if m.meta.family != "regression":
        fail(caller, "regression_only")
    if not quantiles:
        fail(caller, "no_levels")
    if bad := [q for q in quantiles if q is None or not 0 < q < 1]:
        fail(caller, "level", value=bad[0])
    if outcome not in ref.columns:
        fail(caller, "no_column", name=outcome, role="outcome")
    y = number(F.col(f"`{outcome}`"), ref.schema[outcome].dataType)
    seen = landed(cells(ref.withColumn("__y", y), m, ["__y"], na_action).filter("`__y` is not null"), m, n_trees)
    members = seen.groupBy("tree", "node", F.col("__y").alias("y")).agg(F.count("*").alias("n_y"))
    sizes = members.groupBy("tree", "node").agg(F.sum("n_y").alias("n_t"))
    members = members.join(sizes, ["tree", "node"]).select("tree", "node", "y", (F.col("n_y") / F.col("n_t")).alias("share"))
    whole = ordinals(new, None, RID)
    walk = landed(cells(whole, m, [RID], na_action), m, n_trees).select(RID, "tree", "node")
    weights = walk.join(members, ["tree", "node"]).groupBy(RID, "y").agg(F.sum("share").alias("w"))
    trees = walk.groupBy(RID).agg(F.count("*").alias("t_x"))
    upto = Window.partitionBy(RID).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    spread = weights.join(trees, RID).withColumn("cw", F.sum(F.col("w") / F.col("t_x")).over(upto))
    levels = F.map_from_entries(F.array(*(F.struct(F.lit(float(q)).alias("k"), F.min(F.when(F.col("cw") + 1e-12 >= q, F.col("y"))).alias("v")) for q in dict.fromkeys(quantiles))))
    found = spread.groupBy(RID).agg(levels.alias("quantile_pred"))
    return whole.join(found, RID, "left").select(*(F.col(f"`{c}`") for c in new.columns), "quantile_pred")
