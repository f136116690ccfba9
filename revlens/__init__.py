"""revlens: review-sentiment analytics on Spark.

Batch preparation and training (MLlib), stream scoring (Structured
Streaming), and a library of DataFrame queries and data-quality checks
over the stored prediction table. Everything is expressed with built-in
Spark SQL expressions so Catalyst can prune, push down and code-generate.
"""

__all__ = ["session"]
