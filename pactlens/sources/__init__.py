"""sources of the clause risk engine."""
