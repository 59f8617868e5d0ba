"""Source readers. A source is any function ``SparkSession -> DataFrame`` with the record schema."""
