"""Analytics over Parquet tables and event streams, written as ordinary Spark jobs."""
