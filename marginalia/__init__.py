"""marginalia: code-comment corpora on Spark.

Operators are functions from DataFrames to DataFrames; nothing here starts a session on import.
"""

__version__ = "0.1.0"
