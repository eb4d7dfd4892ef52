"""Whole-scan plans, the derived corpus and the registered queries."""
