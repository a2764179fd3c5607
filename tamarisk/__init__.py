"""tamarisk: hybrid retrieval and corpus analytics expressed as Spark DataFrames."""
