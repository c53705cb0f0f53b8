"""Play records and other repeated-trial logs as Spark DataFrames."""
