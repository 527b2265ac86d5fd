"""Table operators.  Each takes and returns DataFrames."""
