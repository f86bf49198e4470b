"""Stratavane: a PySpark-native analytics engine for points, frames, masks, boxes,
embeddings and labels, plus corpus operators in the optional ``llm`` subpackage."""

__version__ = "0.1.0"
