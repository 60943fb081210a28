"""Registered queries and the SQL they are held against."""
