"""Name resolution and trait enrichment on Spark."""
