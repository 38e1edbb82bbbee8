"""Event analytics on Spark: DataFrame operators over append-only event data."""
