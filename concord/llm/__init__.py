"""Operators for training-data pipelines. Nothing else in the engine imports this subpackage."""
