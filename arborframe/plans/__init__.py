"""Plans: how training, prediction and cross-validation become Spark jobs."""
