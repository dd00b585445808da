"""Rule tables and helpers that turn them into expressions or small DataFrames."""
