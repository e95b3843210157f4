"""Registered queries: one per operator, each with its independent SQL check."""
