"""Compositions of operators: derived test tables, queries and whole runs."""
