"""Operators for preparing training text at scale; nothing else in the library imports this subpackage.

Each module holds one operator with its own general interface; ``queries`` applies them to the driver tables.
"""
