"""quire: PDF corpora as queryable tables, and training-data operators, on PySpark."""
