"""streaming of the clause risk engine."""
