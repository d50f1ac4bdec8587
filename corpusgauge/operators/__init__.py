"""Set-wise operators: every function takes and returns DataFrames."""
