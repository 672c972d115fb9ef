"""Operators for preparing training text at corpus scale; nothing else in quirefold imports this subpackage."""
