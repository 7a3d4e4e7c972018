"""As-of retrieval, feature building and evaluation on PySpark DataFrames."""

__version__ = "0.1.0"
