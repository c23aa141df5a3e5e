"""Operators wired to the driver's tables, with the SQL each result must equal."""
