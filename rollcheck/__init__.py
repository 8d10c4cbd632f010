"""Record reconciliation and data-quality operators on Spark DataFrames."""
