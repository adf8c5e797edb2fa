"""What tables and parameters have to be like, and what is said where they are not."""

from __future__ import annotations


class ForestError(ValueError):
    """A parameter or a table that a forest can't be made of."""


#: Each rule by name: what was found, what is allowed, what to do.
RULES = {
    # names
    "reserved_columns": 'this table has columns whose names start with "{prefix}" ({names}). That prefix is reserved for the library; give them other names.',
    "reserved_table": 'a table called "{name}" can\'t be used: names that start with "{prefix}" are reserved for the library.',
    "no_column": 'there is no column "{name}" to serve as {role}.',
    "features_unknown": "features names columns that the table lacks or that have another role: {names}.",
    "feature_is_output": 'the feature "{name}" collides with what predictions will be called; fit with that column under another name.',
    "output_taken": 'predictions would be called "{name}", which collides with a column of the table to be scored.',
    # rows and cells
    "empty_table": "nothing to fit: the table is empty.",
    "no_features": "no feature is left once outcome, weights and keys are set aside.",
    "feature_types": "unsupported types: {found}. A feature can be a number, a boolean or a string; cast other columns first, or leave them out.",
    "outcome_type": 'regression takes a numeric outcome, and "{name}" is of type {kind}.',
    "null_features": "these features are entirely NULL: {names}. Fill them, or fit without them.",
    "null_outcome": 'every value of the outcome "{name}" is missing (entirely NULL).',
    "no_complete_rows": "each row lacks at least one value, so that no row is left to learn from.",
    "odd_features": "NaN or infinite values occur in {names}; only finite numbers can be ordered by a split.",
    "odd_outcome": 'the outcome "{name}" is NaN or infinite in some rows; remove those rows.',
    "one_class": 'a classifier has nothing to tell apart: "{name}" holds a single class, "{value}".',
    "many_classes": 'the outcome "{name}" has more than {most} classes. Each class is a column of every sum, so that so many don\'t fit; use regression for a number.',
    "odd_weights": 'weights must be finite numbers; "{name}" has others.',
    "negative_weights": 'weights below zero were found in "{name}".',
    "zero_weights": 'the weights in "{name}" add up to nothing; their sum must be above zero.',
    # parameters
    "at_least": "{name} is {value}; the least that makes sense is {least}.",
    "mtry": "mtry is {value}; between 1 and {most} features can be drawn for a node here.",
    "max_depth": "max_depth is {value}; give a depth from 1 to {most}, or None for no limit of your own.",
    "sample_frac": "sample_frac is {value}; it is a share of the rows, above 0 and up to 1.",
    "one_of": "{name} is {value}; it can be {allowed}.",
    "no_seed": "seed is None; bags and draws follow from it, so that an integer is needed.",
    "tree_range": "trees tree_from={first} to tree_to={last} aren't a range within the forest's 1 to {n_trees}.",
    "k": "k must be 2 or more to hold a fold out; it is {value}.",
    "empty_grid": "{name} holds no value to try.",
    "grid": "{name} holds {value}; its values run from 1 to {most}.",
    "few_rows": "with so few complete rows some fold would leave nothing to train on.",
    "no_levels": "quantiles holds no level; list at least one between 0 and 1.",
    "level": "quantiles holds {value}; levels lie strictly between 0 and 1.",
    # models and scoring
    "empty_model": "the model table is empty; it has no node to start from.",
    "other_family": "this is a {family} forest; call the {family} function instead.",
    "regression_only": "quantiles are read from a regression forest; this model is a classification forest.",
    "oob_rows": "out-of-bag rows are told by their number in the training table. The model saw {trained} complete rows and this table has {found}; pass the table that was fitted.",
    "oob_table": "this table has as many rows as the training table but not its contents or its order (the fingerprint differs); pass the table that was fitted, with the same order_by.",
    "nothing_to_judge": "no rows have both an outcome and a prediction, so that there is nothing to measure.",
}


def fail(caller: str, rule: str, **given: object) -> None:
    raise ForestError(f"{caller}: {RULES[rule].format(**given)}")
