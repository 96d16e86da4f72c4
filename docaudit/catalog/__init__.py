"""Registered queries, each with its SQL equivalent where SQL can express it."""
