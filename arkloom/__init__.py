"""Web-archive and text analytics on Spark DataFrames."""
