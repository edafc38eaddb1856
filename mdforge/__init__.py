"""mdforge: turn large tables of captured web pages into clean, chunked Markdown on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function whose core work is
expressed with built-in Catalyst expressions (regex, higher-order array functions,
joins, aggregates and windows), so it partitions and scales with the cluster.
"""

__version__ = "0.1.0"
