"""Batch operators: tables in, tables out."""
