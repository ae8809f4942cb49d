"""Operators: functions from DataFrames to DataFrames.

Conventions: ``nodes(graph_id, id, ...)``, ``edges(graph_id, src, dst, ...)``; results keep ``graph_id``.
"""
