"""Row-level text normaliser; plain Python, no Spark."""
