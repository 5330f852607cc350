"""Archive analytics on PySpark: catalogs, members and metadata of ZIP archives as DataFrames."""

__version__ = "0.1.0"
