"""Web-page cleaning and corpus analytics on PySpark DataFrames."""
