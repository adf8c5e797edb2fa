"""What features matter: by impurity (MDI) and by permutation; and a model's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.prepare import check_columns, check_name, finite, number, ordinals, typed_cells
from ..plans.rules import fail
from ..plans.schema import EPS
from ..sources.tables import resolve
from .descend import RID, landed, open_model
from .predict import voted, winner
from .score import fits, scored


def importance(model) -> DataFrame:
    """feature, importance: gains by feature as shares of each tree's total (a tree without splits counts as none), their mean
    over the forest, scaled to sum to one; zero for all if there is no split."""
    m = open_model(model, "importance")
    nodes = m.nodes
    roots = nodes.filter("node = 1").select("tree", F.col("w_node").alias("w_root"))
    raw = nodes.filter("not is_leaf").join(F.broadcast(roots), "tree").groupBy("tree", F.col("split_feature").alias("feature")).agg(F.sum(F.try_divide("imp_decrease", "w_root")).alias("raw"))
    totals = raw.groupBy("tree").agg(F.sum("raw").alias("total")).filter("total > 0")
    mean = raw.join(F.broadcast(totals), "tree").groupBy("feature").agg((F.sum(F.col("raw") / F.col("total")) / F.lit(m.meta.n_trees)).alias("mean"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in m.meta.features], "feature string")
    out = every.join(mean, "feature", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    whole = out.agg(F.sum("mean")).first()[0]
    return out.select("feature", (F.col("mean") / F.lit(whole) if whole > 0 else F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")


def permutation_importance(model, table, outcome: str, n_repeats: int = 5, seed: int = 42, order_by: list[str] | None = None) -> DataFrame:
    """feature, importance, importance_std: the mean loss of score (r2 or accuracy) when the feature's values are shuffled
    among the rows, over n_repeats shuffles, and its population deviation."""
    caller = "permutation_importance"
    check_name(caller, table)
    check_name(caller, model)
    df = resolve(table)
    check_columns(caller, df)
    m = open_model(model, caller)
    if n_repeats is None or n_repeats < 1:
        fail(caller, "at_least", name="n_repeats", value=n_repeats, least=1)
    if outcome not in df.columns:
        fail(caller, "no_column", name=outcome, role="outcome")
    regression = m.meta.family == "regression"
    num, cat = typed_cells(m.features, df)
    y = number(F.col(f"`{outcome}`"), df.schema[outcome].dataType) if regression else F.col(f"`{outcome}`").cast("string")
    keys = {f"__o{k}": F.col(f"`{c}`") for k, c in enumerate(order_by or [])}
    rows = df.select(*(c.alias(k) for k, c in keys.items()), y.alias("y"), num.alias("num"), cat.alias("cat"))
    rows = rows.filter(F.col("y").isNotNull() & F.forall(F.arrays_zip("num", "cat"), lambda x: x["num"].isNotNull() | x["cat"].isNotNull()))
    if regression:
        rows = rows.filter(finite(F.col("y")))
    rows = ordinals(rows, list(keys) or None, RID).drop(*keys)
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, importance double, importance_std double")
    d = len(m.features)
    names = F.array(*(F.lit(f) for f, _ in m.features))
    # one sort of all shuffles: the place within a shuffle is the place overall less the shuffles before
    jobs = rows.select(RID, "num", "cat", F.explode(F.sequence(F.lit(0), F.lit(d * n_repeats - 1))).alias("job"))
    j, rep = (F.col("job") / n_repeats).cast("int"), F.col("job") % n_repeats + 1
    key = rng.rank_key(F.concat_ws(":", F.lit(f"{seed}:P"), names[j], rep, F.col(RID)))
    shuffled = jobs.select("job", RID, key.alias("r"), F.col("num")[j].alias("v"), F.col("cat")[j].alias("lv"))
    placed = ordinals(shuffled.withColumnRenamed(RID, "i"), ["job", "r", "i"], "at")
    cells = placed.select("job", (F.col("at") - F.col("job").cast("long") * n).alias(RID), "v", "lv")
    patch = lambda c, new: F.transform(c, lambda x, i: F.when(i == j, F.col(new)).otherwise(x))
    trial = cells.join(rows, RID).select("job", RID, "y", patch("num", "v").alias("num"), patch("cat", "lv").alias("cat"))
    trial = trial.unionByName(rows.select(F.lit(-1).alias("job"), RID, "y", "num", "cat"))
    classes = m.classes
    if fits(m):
        out = trial.withColumn("s", scored(F.col("num"), F.col("cat"), m, "null", None))
        guess = F.col("s")[0] if regression else winner(classes, [F.col("s")[i] for i in range(len(classes))])
    else:
        out = voted(landed(trial, m), m, ["job", RID, "y"])
        guess = F.col("prediction" if regression else "pred")
    out = out.select("job", "y", guess.alias("guess")).filter("guess is not null")
    if regression:
        mean = rows.agg(F.avg("y")).first()[0]
        sst = rows.agg(F.sum((F.col("y") - mean) * (F.col("y") - mean))).first()[0]
        gap = F.col("y") - F.col("guess")
        scores = out.groupBy("job").agg((1 - F.sum(gap * gap) / sst if sst else F.lit(None).cast("double")).alias("score"))
    else:
        scores = out.groupBy("job").agg(F.avg((F.col("guess") == F.col("y")).cast("double")).alias("score"))
    found = {r.job: r.score for r in scores.collect()}  # features x repeats rows
    result = []
    for k, (f, _) in enumerate(m.features):
        losses = [None if found[-1] is None else found[-1] - found[k * n_repeats + r] for r in range(n_repeats)]
        mean = None if None in losses else sum(losses) / n_repeats
        result.append((f, mean, None if mean is None else (sum((x - mean) ** 2 for x in losses) / n_repeats) ** 0.5))
    frame = df.sparkSession.createDataFrame(result, "feature string, importance double, importance_std double")
    return frame.orderBy(F.desc("importance"), "feature")


def summary(model) -> DataFrame:
    """One row on how the forest was fitted and what grew; depth_cap_hit tells whether an impure leaf lies at max_depth."""
    m = open_model(model, "summary")
    one = lambda c: F.first(c).alias(c)
    return m.nodes.agg(
        one("family"), one("n_trees"), F.count("*").alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.max("depth").alias("max_depth_reached"), F.avg(F.when(F.col("is_leaf"), F.col("depth"))).alias("mean_leaf_depth"),
        F.bool_or(F.col("is_leaf") & (F.col("depth") == F.col("max_depth")) & (F.col("impurity") > EPS)).alias("depth_cap_hit"), F.first(F.size("features")).alias("n_features"),
        *map(one, ("mtry", "max_depth", "criterion", "splitter", "seed", "n_train", "sample_frac", "replace_sample")),
    )
