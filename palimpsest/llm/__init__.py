"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator projects
the columns it needs under names of its own before anything else, so extra or
clashing columns of the input never matter.
"""
