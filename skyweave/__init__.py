"""Skyweave: light-curve mining and corpus jobs written for Spark."""
