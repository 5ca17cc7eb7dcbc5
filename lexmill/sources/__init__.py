"""Corpus and label files in, label files out."""

from lexmill.sources.corpus import PLAIN, Loader, label_lines, line_index
from lexmill.sources.sinks import write_labels

__all__ = ["PLAIN", "Loader", "label_lines", "line_index", "write_labels"]
