"""How good predictions are, in and out of bag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.keep import cut
from ..plans.prepare import check_name, number
from ..plans.rules import fail
from ..sources.tables import resolve
from .descend import open_model
from .predict import oob_predict_classifier, oob_predict_regressor, predict_classifier, predict_regressor


def regression_metrics(df: DataFrame, y: Column, yhat: Column, caller: str) -> DataFrame:
    """n, rmse, mae, r2 over the rows with both."""
    rows = df.select(y.alias("y"), yhat.alias("yhat")).filter("y is not null and yhat is not null")
    gap = F.col("y") - F.col("yhat")
    sums = rows.agg(F.count("*").alias("n"), F.sum(gap * gap).alias("sse"), F.sum(F.abs(gap)).alias("sae"), (F.var_pop("y") * F.count("*")).alias("sst"))
    found = sums.first()  # one pass over the scores; the rest is arithmetic on one row
    if not found.n:
        fail(caller, "nothing_to_judge")
    sums = df.sparkSession.createDataFrame([found], sums.schema)
    return sums.select("n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"), (1 - F.try_divide("sse", "sst")).alias("r2"))


def classification_metrics(df: DataFrame, y: Column, probs: Column, pred: Column, classes: list[str], caller: str) -> DataFrame:
    """n, accuracy, log_loss, brier, auc (of two classes; the positive one is the greater label) over the rows with both."""
    p = [F.element_at(probs, F.lit(c)) for c in classes]
    rows = df.select(y.cast("string").alias("y"), pred.alias("pred"), *(x.alias(f"p_{i}") for i, x in enumerate(p))).filter("y is not null and p_0 is not null")
    rows = cut(rows)  # scores are made once, for the means and for the ranks
    hit = [(F.col("y") == c).cast("double") - F.col(f"p_{i}") for i, c in enumerate(classes)]
    true = F.coalesce(*(F.when(F.col("y") == c, F.col(f"p_{i}")) for i, c in enumerate(classes)), F.lit(None).cast("double"))
    loss = -F.log(F.least(F.greatest(true, F.lit(1e-15)), F.lit(1 - 1e-15)))
    brier = sum((x * x for x in hit[1:]), hit[0] * hit[0]) * (0.5 if len(classes) < 3 else 1.0)
    out = rows.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"), F.avg(brier).alias("brier"))
    if not out.first().n:
        fail(caller, "nothing_to_judge")
    if len(classes) != 2:
        return out.withColumn("auc", F.lit(None).cast("double"))
    return out.crossJoin(area(rows.select((F.col("y") == classes[1]).cast("long").alias("pos"), F.col("p_1").alias("p"))))


def area(rows: DataFrame) -> DataFrame:
    """auc of pos (0, 1) and p, by mean ranks. Rows are counted by distinct p first; ranks are running sums over those."""
    counts = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))
    # running sums over distinct scores: within partitions of a range sort, plus what lies in those before
    sorted_ = cut(counts.repartitionByRange("p")).withColumn("part", F.spark_partition_id())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sorted_.join(F.broadcast(parts), "part").withColumn("rank", F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranks.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auc"))


def _table(table: DataFrame | str, caller: str) -> DataFrame:
    check_name(caller, table)
    return resolve(table)


def _truth(df: DataFrame, outcome: str, caller: str) -> Column:
    if outcome not in df.columns:
        fail(caller, "nothing_to_judge")
    return F.col(f"`{outcome}`")


def evaluate_regressor(model, table, outcome: str, na_action: str = "null", n_trees: int | None = None) -> DataFrame:
    df, caller = _table(table, "evaluate_regressor"), "evaluate_regressor"
    y = number(_truth(df, outcome, caller), df.schema[outcome].dataType)
    return regression_metrics(predict_regressor(model, _free(df, outcome), na_action, n_trees), y, F.col("prediction"), caller)


def evaluate_classifier(model, table, outcome: str, na_action: str = "null", n_trees: int | None = None) -> DataFrame:
    df, caller = _table(table, "evaluate_classifier"), "evaluate_classifier"
    m = open_model(model, caller, "classification")
    y = _truth(df, outcome, caller)
    return classification_metrics(predict_classifier(model, _free(df, outcome), na_action, n_trees), y, F.col("probs"), F.col("pred"), m.classes, caller)


def _free(df: DataFrame, outcome: str) -> DataFrame:
    """df without columns named as outputs are, but for the outcome."""
    return df.drop(*(c for c in df.columns if c.lower() in ("pred", "probs", "prediction") and c != outcome))


def oob_regressor(model, table, outcome: str, order_by: list[str] | None = None) -> DataFrame:
    """The metrics of out-of-bag predictions, and n_excluded, the training rows that every tree bagged."""
    df, caller = _table(table, "oob_regressor"), "oob_regressor"
    m = open_model(model, caller, "regression")
    y = number(_truth(df, outcome, caller), df.schema[outcome].dataType)
    out = regression_metrics(oob_predict_regressor(model, df, order_by), y, F.col("prediction"), caller)
    return out.withColumn("n_excluded", F.lit(m.meta.n_train).cast("long") - F.col("n"))


def oob_classifier(model, table, outcome: str, order_by: list[str] | None = None) -> DataFrame:
    df, caller = _table(table, "oob_classifier"), "oob_classifier"
    m = open_model(model, caller, "classification")
    out = classification_metrics(oob_predict_classifier(model, df, order_by), _truth(df, outcome, caller), F.col("probs"), F.col("pred"), m.classes, caller)
    return out.withColumn("n_excluded", F.lit(m.meta.n_train).cast("long") - F.col("n"))
