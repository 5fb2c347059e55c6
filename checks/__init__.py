"""Registered queries and the SQL that says what they must return."""
