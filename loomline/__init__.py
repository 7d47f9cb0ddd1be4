"""loomline: document and question-answering analytics on Spark DataFrames."""
