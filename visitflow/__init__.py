"""Session analytics and feature preparation on Spark DataFrames."""

from visitflow.plans.pipeline import FittedPipeline, fit_pipeline, fit_transform
from visitflow.plans.training import Training, train_and_evaluate
from visitflow.session import build_session, temporary_tables

__all__ = [
    "FittedPipeline",
    "Training",
    "build_session",
    "fit_pipeline",
    "fit_transform",
    "temporary_tables",
    "train_and_evaluate",
]
