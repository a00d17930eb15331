"""Knowledge bases over source code and documents, on Spark DataFrames."""
