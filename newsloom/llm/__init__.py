"""Training-data operators: dedup, filtering, scoring, packing and extraction.

Nothing outside this folder imports it; the folder can be removed as a whole.
"""
