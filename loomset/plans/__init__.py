"""Whole flows, and the catalogue of queries over the test tables with their SQL twins."""
