"""Rules: syntax trees, parser, checks, compiler to DataFrames, ready programs and placement advice."""
