"""Panel operators over DataFrames."""
