"""Event histories on Spark: one temporal event model, and deterministic questions over it."""
