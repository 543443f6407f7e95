"""An analytics engine for sequential game records, documents and graphs, on Spark DataFrames."""
