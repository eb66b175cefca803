"""Policies, and the registered queries."""
