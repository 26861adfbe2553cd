"""Operators over extraction results: references, outlines, markup, inventories, runs, comparisons, cards."""
