"""Operators put together: the layered tables, recommendations and registered queries."""
