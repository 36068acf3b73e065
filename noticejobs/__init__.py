"""Batch and streaming jobs for public-sector announcements on Spark."""
