"""Building blocks shared by the operators: written tables, the fixpoint loop, graph views."""
