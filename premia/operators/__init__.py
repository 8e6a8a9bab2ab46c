"""Operators on quote rows, each a composition of DataFrame expressions."""
