"""Queries over facts: detectors, graph operators, suppression."""
