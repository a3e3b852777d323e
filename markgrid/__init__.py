"""Answer-sheet analytics on Spark."""
