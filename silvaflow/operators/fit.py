"""Fitting forests, whole or in ranges of trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..plans.prepare import Fit, check_fit, check_name, training_rows
from ..plans.rules import fail
from ..sources.tables import resolve
from .grow import Grower, bagged, with_meta

FAMILIES = ("classification", "regression")


def _fit(table, outcome: str, family: str, caller: str, order_by: list[str] | None, **given) -> DataFrame:
    check_name(caller, table)
    df = resolve(table)
    p = Fit(outcome=outcome, family=family, caller=caller, **given)
    check_fit(p, df)
    rows = training_rows(p, df, order_by)
    return with_meta(p, Grower(p).grow(bagged(p, rows), p.tree_to - p.tree_from + 1))


def fit_classifier(
    table: DataFrame | str, outcome: str, n_trees: int = 100, mtry: int | None = None, max_depth: int | None = 20, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0,
    sample_frac: float = 1.0, replace_sample: bool = True, criterion: str = "gini", seed: int = 42, weights_col: str | None = None, class_weight: str | None = None, tree_from: int | None = None,
    tree_to: int | None = None, splitter: str = "best", order_by: list[str] | None = None, features: list[str] | None = None,
) -> DataFrame:
    """A classification forest as a model table, one row for each tree node. Every other column of table is a feature (numbers,
    booleans, strings), or those that features names; a row with a null in any column is left out either way. order_by are keys that number the rows (bags are drawn by number); without them rows are numbered
    as Spark reads them."""
    return _fit(table, outcome, "classification", "fit_classifier", order_by, **{k: v for k, v in locals().items() if k not in ("table", "outcome", "order_by", "features")}, wanted=features)


def fit_regressor(
    table: DataFrame | str, outcome: str, n_trees: int = 100, mtry: int | None = None, max_depth: int | None = 20, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0,
    sample_frac: float = 1.0, replace_sample: bool = True, criterion: str = "mse", seed: int = 42, weights_col: str | None = None, tree_from: int | None = None, tree_to: int | None = None,
    splitter: str = "best", order_by: list[str] | None = None, features: list[str] | None = None,
) -> DataFrame:
    """A regression forest as a model table."""
    return _fit(table, outcome, "regression", "fit_regressor", order_by, **{k: v for k, v in locals().items() if k not in ("table", "outcome", "order_by", "features")}, wanted=features)


def batch_ranges(n_trees: int = 100, batch_size: int = 10) -> list[tuple[int, int]]:
    """Tree ranges of batch_size trees that cover 1..n_trees."""
    caller = "batch_ranges"
    if n_trees is None or n_trees < 1:
        fail(caller, "at_least", name="n_trees", value=n_trees, least=1)
    if batch_size is None or batch_size < 1:
        fail(caller, "at_least", name="batch_size", value=batch_size, least=1)
    return [(k, min(k + batch_size - 1, n_trees)) for k in range(1, n_trees + 1, batch_size)]


def batched_fit_plan(table: str, outcome: str, family: str, n_trees: int = 100, batch_size: int = 10, **given) -> str:
    """The text of a Python expression that fits the batches and unites them; n_trees stays the whole forest's."""
    if family not in FAMILIES:
        fail("batched_fit_plan", "one_of", name="family", value=repr(family), allowed=" or ".join(map(repr, FAMILIES)))
    name = "fit_classifier" if family == "classification" else "fit_regressor"
    if family == "regression":
        given.pop("class_weight", None)
    if given.get("criterion", 0) is None:
        given.pop("criterion")
    more = "".join(f", {k}={v!r}" for k, v in given.items())
    calls = [f"{name}({table!r}, {outcome!r}, n_trees={n_trees}, tree_from={a}, tree_to={b}{more})" for a, b in batch_ranges(n_trees, batch_size)]
    return calls[0] + "".join(f".unionByName({c})" for c in calls[1:])


def fit_batched(table: DataFrame | str, outcome: str, family: str, n_trees: int = 100, batch_size: int = 10, **given) -> DataFrame:
    """The forest fitted batch by batch, so that the rows in work are those of batch_size trees."""
    if family not in FAMILIES:
        fail("fit_batched", "one_of", name="family", value=repr(family), allowed=" or ".join(map(repr, FAMILIES)))
    fit = fit_classifier if family == "classification" else fit_regressor
    if given.get("criterion", 0) is None:
        given.pop("criterion")
    return reduce(DataFrame.unionByName, (fit(table, outcome, n_trees=n_trees, tree_from=a, tree_to=b, **given) for a, b in batch_ranges(n_trees, batch_size)))
