"""Registered queries, each with its SQL statement of the same result."""
