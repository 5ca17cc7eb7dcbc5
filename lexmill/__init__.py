"""lexmill: document classification as Spark DataFrame plans."""
