"""quillframe: document-image matching and corpus preparation on Spark DataFrames."""
