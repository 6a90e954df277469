"""Queries over the tables of a folder, and the same in SQL."""
