"""Batch and streaming jobs for hydrological monitoring data on Spark."""
