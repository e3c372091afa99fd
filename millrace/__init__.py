"""millrace: a DataFrame-first retrieval analytics and text-corpus engine on PySpark."""

__version__ = "0.1.0"
