"""Operators for large-scale training-data pipelines; nothing else in binframe imports this subpackage."""
