"""kinfold: record unification on Spark DataFrames."""
