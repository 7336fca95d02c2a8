"""plans of the clause risk engine."""
