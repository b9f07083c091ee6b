"""Fork-aware block streams on Spark."""
