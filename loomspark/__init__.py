"""Discussion analytics on PySpark: text cleaning, labelling, ranking, indexing."""
