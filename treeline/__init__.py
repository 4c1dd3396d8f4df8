"""Spark jobs for is-a hierarchies: load, clean, propose, prune, score and summarise edges as DataFrames."""
