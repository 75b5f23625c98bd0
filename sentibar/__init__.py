"""sentibar: price-bar and news-event analytics as lazy Spark DataFrame operators.

Layout:
  functions/  column-expression helpers (no actions, no Python UDFs)
  operators/  DataFrame -> DataFrame building blocks (windows, aggregates, joins)
  sources/    readers, writers and the mapping of the shared test tables
  plans/      composed pipelines and the query catalogue with its SQL twins
  streaming/  incremental (Structured Streaming) form of article alignment
"""

__version__ = "0.1.0"
