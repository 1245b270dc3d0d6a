"""Stateful twins of the batch operators."""
