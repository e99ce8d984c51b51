"""Whole dataflows built from the operators."""
