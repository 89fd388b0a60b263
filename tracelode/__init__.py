"""tracelode: agent-trace and evaluation-data analytics on Spark DataFrames."""
