"""tripleloom: a rule and graph-data engine on Spark DataFrames."""
