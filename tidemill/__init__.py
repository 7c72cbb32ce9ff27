"""tidemill: a Spark-native analytics engine over open Parquet data."""

__version__ = "0.1.0"
