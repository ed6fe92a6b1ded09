"""Operators for preparing training data; nothing else in glossweave imports this subpackage."""
