"""Set-oriented audit of invoice and receipt corpora on Spark DataFrames."""
