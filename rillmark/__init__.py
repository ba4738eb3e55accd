"""rillmark: product analytics and event processing on Spark DataFrames."""
