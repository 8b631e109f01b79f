"""corpusloom: code- and document-corpus analytics on PySpark."""
