"""Version-history analytics on Spark: objects, commit graphs, trees, refs, logs and texts as tables."""
