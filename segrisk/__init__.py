"""Segment-risk analytics on Spark: attribute joins, spatial crash counts, count models and their evaluation."""
