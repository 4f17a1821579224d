"""Operators on sequences: statistics, n-grams, suffix sorting, transforms, runs, pattern counting."""
