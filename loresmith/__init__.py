"""loresmith: a text-knowledge analytics engine on Spark DataFrames."""
