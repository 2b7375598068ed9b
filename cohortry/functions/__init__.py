"""Column helpers and p-value functions."""
