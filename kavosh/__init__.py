"""Persian text analysis, retrieval and evaluation as Spark DataFrame operators."""
