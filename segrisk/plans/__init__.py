"""Compositions of the operators: the pipeline, the derived inputs, and the query catalogue with its SQL."""
