"""Whole queries made of operators, sources and sinks."""
