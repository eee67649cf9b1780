"""Relational and stateful operators over flows."""
