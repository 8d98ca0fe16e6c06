"""clipworks: document curation and analytics on PySpark DataFrames."""
