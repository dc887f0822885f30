"""gridflow: spreadsheet landing, typing and sync as Spark DataFrame operators.

Modules:
  sources/    landing documents, decoding workbooks, SQL and table reads
  functions/  column -> column helpers (names, uuids, content bytes, globs)
  operators/  grid, keyed, gate, quality and contract operators
  sinks/      table creation, append, replace, keyed writes, watermarks
  plans/      composite jobs and the registered queries
  streaming/  debounced triggers and the continuous sync stream
"""

from gridflow.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
