"""Operators for preparing training data at scale.  Nothing else in cairn imports this subpackage."""
