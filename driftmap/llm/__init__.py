"""Operators for large-scale training-data work; nothing else in driftmap imports this subpackage."""
