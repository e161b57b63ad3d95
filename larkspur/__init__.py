"""larkspur: a small Spark-first analytics library over DataFrames."""
