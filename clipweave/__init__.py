"""Timeline and annotation analytics as PySpark DataFrame operators."""

SEC = 1_000_000  # time columns are BIGINT microseconds; one second
