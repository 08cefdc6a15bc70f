"""weftline: a PySpark-native text insight engine (cleaning, retrieval, fusion, clustering, event replay)."""

__version__ = "0.1.0"
