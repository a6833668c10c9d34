"""weft: attributed property graphs and relational analytics as Spark DataFrames."""
