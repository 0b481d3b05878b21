"""Registered queries with the SQL each is compared to."""
