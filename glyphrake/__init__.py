"""glyphrake: exact pattern search over large text corpora, expressed as Spark DataFrames."""
