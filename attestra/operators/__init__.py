"""Operators on tables: intervals, layout, lines, trees, retrieval, evidence, verification, catalogue, records."""
