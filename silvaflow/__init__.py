"""Random forests and extremely randomised trees on Spark DataFrames. A fitted forest is a table, one row for each node."""

from .operators.cv import cv_depth, cv_mtry
from .operators.fit import batch_ranges, batched_fit_plan, fit_batched, fit_classifier, fit_regressor
from .operators.importance import importance, permutation_importance, summary
from .operators.metrics import evaluate_classifier, evaluate_regressor, oob_classifier, oob_regressor
from .operators.predict import (
    oob_predict_classifier,
    oob_predict_regressor,
    predict_classifier,
    predict_quantiles,
    predict_regressor,
    predict_trees_classifier,
    predict_trees_regressor,
)
from .plans.prepare import ForestError
from .sources.tables import load_model, read_table, save_model
from .streaming.score import score_stream, write_scores

__all__ = [
    "ForestError", "batch_ranges", "batched_fit_plan", "cv_depth", "cv_mtry", "evaluate_classifier", "evaluate_regressor", "fit_batched", "fit_classifier", "fit_regressor", "importance", "load_model",
    "oob_classifier", "oob_predict_classifier", "oob_predict_regressor", "oob_regressor", "permutation_importance", "predict_classifier", "predict_quantiles", "predict_regressor",
    "predict_trees_classifier", "predict_trees_regressor", "read_table", "save_model", "score_stream", "summary", "write_scores",
]
