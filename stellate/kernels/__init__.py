"""Per-group algorithms on numpy arrays; nothing here imports Spark."""
