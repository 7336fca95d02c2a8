"""operators of the clause risk engine."""
