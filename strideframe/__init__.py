"""strideframe: DataFrame operators for scoring walking networks on Spark."""
