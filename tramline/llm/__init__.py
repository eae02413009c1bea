"""Training-data operators: one module for each, plus their registered queries.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
