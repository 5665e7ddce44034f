"""Analytics over catalogues of public notices, as Spark DataFrames."""
