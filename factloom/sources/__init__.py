"""Readers of tables and of text folders."""
