"""quillstone: document-collection analytics on PySpark DataFrames."""
