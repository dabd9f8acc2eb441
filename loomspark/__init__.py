"""loomspark: token-budgeted chunking and chunk analytics on PySpark DataFrames."""

__version__ = "0.1.0"
