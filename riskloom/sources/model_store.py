"""Saving a fitted model and reading it back."""

from __future__ import annotations

from pyspark.ml import PipelineModel

# Fixed value: the name a best model is saved under.
MODEL_NAME = "best_model"


def save_model(model: PipelineModel, folder: str, name: str = MODEL_NAME) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
