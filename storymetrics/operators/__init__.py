"""Relational operators on jobs, frames and metrics."""
