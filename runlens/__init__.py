"""runlens: a PySpark engine for recorded runs of branching jobs, and for training-data pipelines."""
