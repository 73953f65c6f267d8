"""tessera: a SQL analytics engine on Spark DataFrames, with training-data operators beside it."""
