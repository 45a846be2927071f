"""Operators for preparing training text, with their queries and the SQL they must equal."""
