"""Composite jobs over the operators: dataset preparation, analysis, collection, climate runs."""
