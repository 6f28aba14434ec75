"""A Spark-first engine for grounded facts: page scoring, claim normalisation, blocked matching, reconciliation."""
