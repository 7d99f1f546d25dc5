"""A PySpark engine that scores postings against profile texts, with training-data operators in
the separate subpackage ``llm``."""
