"""Spark-first analytics for mailing-list archives and threaded discussions."""
