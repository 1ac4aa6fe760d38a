"""Training-data operators: dedup, decontamination, scoring, search and mixing.

Nothing outside this subpackage imports it. ``queries`` holds one thin query
per operator; the operators themselves keep general interfaces.
"""
