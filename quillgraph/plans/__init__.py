"""Queries made of several operators: linking, sheets, groups, layers, documents and ranked recall."""
