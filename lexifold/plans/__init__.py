"""Registered queries over the tables, and the SQL that gives the same rows."""
