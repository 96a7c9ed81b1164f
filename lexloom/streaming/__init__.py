"""Training from an unbounded feed."""
