"""Classifiers as DataFrame plans."""

from lexmill.plans.bayes import GaussianNaiveBayes, NaiveBayes, SmoothedNaiveBayes
from lexmill.plans.classify import classify, classify_files, first_row, inspect_features
from lexmill.plans.softmax import SoftmaxRegression

__all__ = [
    "GaussianNaiveBayes",
    "NaiveBayes",
    "classify_files",
    "first_row",
    "SmoothedNaiveBayes",
    "SoftmaxRegression",
    "classify",
    "inspect_features",
]
