"""graphfacts: relational, graph and dataflow operators over fact tables, on Spark DataFrames.

Every fact table carries a ``graph_id`` column (a program, an order, a user ...), so one Spark job
answers a question for a whole fleet of graphs.
"""
