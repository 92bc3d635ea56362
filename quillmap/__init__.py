"""quillmap: mapping-quality analytics for aligned reads, written on PySpark DataFrames."""
