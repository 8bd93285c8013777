"""Analytics over meshes, fields and text corpora, on Spark DataFrames."""
