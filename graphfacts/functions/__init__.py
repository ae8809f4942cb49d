"""Scalar functions as column expressions: they stay inside whole-stage code generation."""
