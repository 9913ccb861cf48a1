"""tidemark: monitoring analytics as DataFrame-in, DataFrame-out Spark operators."""
