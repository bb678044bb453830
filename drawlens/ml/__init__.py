"""Models on Spark ML and numpy."""
