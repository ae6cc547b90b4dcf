"""Price-comparison data work as Spark jobs: DataFrame in, DataFrame out."""
