"""millrace: profiling, chunked extraction and run analytics on PySpark."""

__version__ = "0.1.0"
