"""functions of the clause risk engine."""
