"""Scalar functions as column expressions; all stay inside code generation."""
