"""Report compositions: named DataFrames built from the operators, one scan of each fact and aggregates on top."""
