"""The row-wise scan applied to streaming DataFrames."""
