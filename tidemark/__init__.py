"""Market-structure analytics over bar series, as lazy Spark transforms."""
