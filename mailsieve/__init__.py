"""mailsieve: mail-threat analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions   Column -> Column builders (URL rules, text cleaning, features).
operators   DataFrame -> DataFrame operators (dedup, ranking, metrics, models).
sources     scans and table builders (label index, message files, CSV/TSV, replies).
streaming   Structured Streaming jobs over a mail drop folder.
plans       the registered query catalogue and its DuckDB oracle SQL.
"""

__version__ = "0.1.0"
