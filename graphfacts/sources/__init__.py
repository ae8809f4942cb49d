"""Readers and writers: delimited text, exclusion and target lists, manifests, result files, graph text."""
