"""The three whole jobs, composed from the operators."""
