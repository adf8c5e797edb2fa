"""Cross-validation over grids of mtry or depth: all grid values, folds and trees grown together."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.prepare import Fit, bag_size, check_fit, check_name, training_rows
from ..plans.rules import fail
from ..plans.schema import DEPTH_CAP
from ..sources.tables import resolve
from .descend import Model, landed
from .fit import FAMILIES
from .grow import Grower
from .predict import voted


def _cv(caller: str, table, outcome: str, family: str, grid: list[int], sweep: str, k: int, n_trees: int, mtry: int | None, max_depth: int | None, min_samples_leaf: int, sample_frac: float, seed: int, order_by) -> DataFrame:
    check_name(caller, table)
    df = resolve(table)
    if family not in FAMILIES:
        fail(caller, "one_of", name="family", value=repr(family), allowed=" or ".join(map(repr, FAMILIES)))
    if outcome not in df.columns:
        fail(caller, "no_column", name=outcome, role="outcome")
    if k is None or k < 2:
        fail(caller, "k", value=k)
    if not grid:
        fail(caller, "empty_grid", name=f"{sweep}_grid")
    if sweep == "depth" and (bad := [g for g in grid if not 1 <= g <= DEPTH_CAP]):
        fail(caller, "grid", name="depth_grid", value=bad[0], most=DEPTH_CAP)
    p = Fit(outcome=outcome, family=family, caller=caller, n_trees=n_trees, mtry=mtry, max_depth=max_depth, min_samples_leaf=min_samples_leaf, sample_frac=sample_frac, seed=seed, criterion="gini" if family == "classification" else "mse")
    check_fit(p, df)
    if sweep == "mtry" and (bad := [g for g in grid if not 1 <= g <= len(p.features)]):
        fail(caller, "grid", name="mtry_grid", value=bad[0], most=len(p.features))
    rows = training_rows(p, df, order_by)
    n, groups = p.n_train, len(grid) * k
    if n <= k - 1 and n < 2:
        fail(caller, "few_rows")
    # tree t of group g (grid value g div k, held-out fold g mod k) is numbered g * n_trees + t - 1
    by_fold = lambda f: F.element_at(F.array(*(F.lit(f(h)) for h in range(k))), (F.col("held") + 1).cast("int"))
    in_fold = [len(range(h, n, k)) for h in range(k)]
    if any(n == c for c in in_fold):
        fail(caller, "few_rows")
    largest = max(bag_size(sample_frac, n - c) for c in in_fold)
    spark = df.sparkSession
    draws = spark.range(1, largest + 1).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(groups * n_trees - 1))))
    draws = draws.withColumn("g", (F.col("tree") / n_trees).cast("int")).withColumn("held", F.col("g") % k)
    draws = draws.filter(F.col("id") <= by_fold(lambda h: bag_size(sample_frac, n - in_fold[h])))
    key = F.concat_ws(":", F.lit(f"{seed}:cv"), F.col("g"), F.col("tree") % n_trees + 1, F.col("id"))
    j = rng.draw_mod(key, by_fold(lambda h: n - in_fold[h]))
    fold = j % (k - 1)
    # the j-th row outside the held-out fold, without listing them
    i = (j / (k - 1)).cast("long") * k + F.when(fold < F.col("held"), fold).otherwise(fold + 1) + 1
    bag = draws.select("tree", i.cast("long").alias("i")).groupBy("tree", "i").agg(F.count("*").alias("n_drawn"))
    front = bag.join(rows, "i").select("tree", F.col("n_drawn").cast("double").alias("w"), "y", "num", "cat")
    value = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("tree") / (n_trees * k)).cast("int") + 1)

    def draw_key(mark: str, tree: Column, node: Column, what: Column) -> Column:
        return F.concat_ws(":", F.lit(f"{seed}:cv"), (tree / n_trees).cast("int"), tree % n_trees + 1, node, what)

    mtrys = grid if sweep == "mtry" else [p.mtry] * len(grid)
    caps = grid if sweep == "depth" else [p.max_depth] * len(grid)
    nodes = Grower(p, key=draw_key, mtry=value(mtrys), cap=value(caps), cap_max=max(caps)).grow(front, groups * n_trees)
    size = nodes.agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    meta = SimpleNamespace(features=[f for f, _ in p.features], feature_kinds=[kind for _, kind in p.features], classes=p.classes, family=family)
    m = Model(nodes, meta, size.n, size.d)
    group = F.col("gidx") * k + (F.col("i") - 1) % k
    starts = rows.withColumn("gidx", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).withColumn("tree", F.explode(F.sequence((group * n_trees).cast("int"), (group * n_trees + n_trees - 1).cast("int"))))
    found = voted(landed(None, m, None, starts), m, ["gidx", "i", "y"])
    if family == "classification":
        error = F.avg((F.col("pred") != F.col("y")).cast("double"))
    else:
        gap = F.col("y") + F.lit(p.centre) - F.col("prediction")
        error = F.avg(gap * gap)
    errors = {r.gidx: r.e for r in found.groupBy("gidx").agg(error.alias("e")).collect()}  # one row for each grid value
    return spark.createDataFrame([(g, errors.get(x)) for x, g in enumerate(grid)], f"{'mtry' if sweep == 'mtry' else 'max_depth'} int, cv_error double")


def cv_mtry(table, outcome: str, family: str, mtry_grid: list[int], k: int = 5, n_trees: int = 100, max_depth: int | None = 20, min_samples_leaf: int = 1, sample_frac: float = 1.0, seed: int = 42, order_by: list[str] | None = None) -> DataFrame:
    """mtry, cv_error (error rate, or mean squared error) of each grid value; folds are row numbers modulo k."""
    return _cv("cv_mtry", table, outcome, family, mtry_grid, "mtry", k, n_trees, None, max_depth, min_samples_leaf, sample_frac, seed, order_by)


def cv_depth(table, outcome: str, family: str, depth_grid: list[int], mtry: int | None = None, k: int = 5, n_trees: int = 100, min_samples_leaf: int = 1, sample_frac: float = 1.0, seed: int = 42, order_by: list[str] | None = None) -> DataFrame:
    return _cv("cv_depth", table, outcome, family, depth_grid, "depth", k, n_trees, mtry, 20, min_samples_leaf, sample_frac, seed, order_by)


