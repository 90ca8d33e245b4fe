"""Whole runs, from files to index documents."""
