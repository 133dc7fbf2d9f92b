"""rookery: game-record analytics on Spark.

Subpackages: ``sources`` (scans, test-data views), ``functions`` (column
expressions), ``operators`` (report, repertoire, evaluations, narration, PGN),
``plans`` (named queries + oracle SQL), ``streaming`` (incremental jobs).
"""

__version__ = "0.1.0"
