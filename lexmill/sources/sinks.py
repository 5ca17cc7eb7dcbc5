"""Label files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_labels(
    labels: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), label: str = "label"
) -> None:
    """Write one label per line, in key order; part files follow by name."""
    labels.orderBy(*keys).select(label).write.text(path)
