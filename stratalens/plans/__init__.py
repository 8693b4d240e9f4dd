"""Whole analyses: building the tree tables, describing a selection, sweeping configurations."""
