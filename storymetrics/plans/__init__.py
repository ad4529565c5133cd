"""Whole jobs and the queries of the driver."""
