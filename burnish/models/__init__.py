"""Model training, evaluation and attribution."""

from burnish.models.train import MODELS, TrainResult, train

__all__ = ["MODELS", "TrainResult", "train"]
