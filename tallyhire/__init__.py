"""Batch and streaming jobs for hiring-marketplace data, written for Spark."""
