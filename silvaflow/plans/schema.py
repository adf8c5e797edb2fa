"""Kinds of columns and the columns of a model table (one row for each tree node)."""

from __future__ import annotations

from pyspark.sql import types as T

RESERVED = "__rf_"
EPS = 2.220446049250313e-16
DEPTH_CAP = 60

NODE_COLUMNS = {
    "tree": "int", "node": "bigint", "depth": "int", "is_leaf": "boolean", "split_feature": "string", "split_kind": "string", "threshold": "double",
    "cats_left": "array<string>", "cats_right": "array<string>", "unseen_left": "boolean", "n_rows": "bigint", "w_node": "double", "impurity": "double",
    "imp_decrease": "double", "prediction": "double", "class_counts": "map<string,double>",
}
META_COLUMNS = {
    "family": "string", "n_trees": "int", "seed": "bigint", "sample_frac": "double", "replace_sample": "boolean", "n_train": "bigint", "mtry": "int", "max_depth": "int",
    "min_samples_split": "int", "min_samples_leaf": "int", "min_impurity_decrease": "double", "criterion": "string", "splitter": "string", "features": "array<string>",
    "feature_kinds": "array<string>", "classes": "array<string>", "train_hash": "decimal(38,0)",
}
MODEL_COLUMNS = [*NODE_COLUMNS, *META_COLUMNS]


def kind_of(dtype: T.DataType) -> str:
    """'num' (numbers and booleans), 'cat' (strings) or 'bad'."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "num"
    return "cat" if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)) else "bad"


def features_of(schema: T.StructType, *without: str | None) -> list[tuple[str, str]]:
    """Feature columns with their kinds, in the order of their names."""
    return [(f.name, kind_of(f.dataType)) for f in sorted(schema.fields, key=lambda f: f.name) if f.name not in without]
