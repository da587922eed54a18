"""One function per job; inputs and outputs are DataFrames."""
