"""Queries over the shared tables, each with the SQL that gives the same rows."""
