"""Operators that prepare training text: one module for each operator.

Nothing outside this folder imports it.
"""
