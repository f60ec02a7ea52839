"""Train on one model input table, report on its tail and on a test table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from visitflow.operators.clean import LABEL
from visitflow.operators.evaluate import evaluation_report, visitor_predictions
from visitflow.operators.model import SEED, fit_regressor, score
from visitflow.operators.prep import FeaturePrep, apply_prep, fit_prep, numeric_features
from visitflow.operators.split import first_rows, time_split
from visitflow.session import materialize, temporary_tables


@dataclass(frozen=True)
class Training:
    model: PipelineModel
    prep: FeaturePrep
    left_out: list[str]  # columns that are no numbers
    predictions: DataFrame  # per visitor of the test table
    report: DataFrame  # section, metric, value


def train_and_evaluate(
    train_table: DataFrame,
    test_table: DataFrame,
    kind: str = "gbt",
    train_frac: float = 0.9,
    max_train: int | None = None,
    label: str = LABEL,
    seed: int = SEED,
    indices: dict[str, int] | None = None,
    **settings: object,
) -> Training:
    """Time split, preparation fitted on the train part, model, evaluation.

    ``indices`` gives the vocabulary size of columns of category indices, which enter the model one-hot.

    The prepared train rows are written once, so the iterations of the model
    read a table of features and not the lineage behind it; it is deleted after them.
    """
    if max_train is not None:
        train_table = first_rows(train_table, max_train)
    train, validation = time_split(train_table, train_frac)
    features, left_out = numeric_features(train)
    prep = fit_prep(train, features, indices=indices)
    with temporary_tables(train_table.sparkSession):
        ready = materialize(apply_prep(train, prep), "train-features")
        model = fit_regressor(ready, prep.features, label, kind, seed, one_hot=prep.indices, **settings)
    validated = score(model, apply_prep(validation, prep), floor=False)
    tested = score(model, apply_prep(test_table, prep))
    return Training(
        model,
        prep,
        left_out,
        visitor_predictions(tested),
        evaluation_report(validated, tested, label),
    )
