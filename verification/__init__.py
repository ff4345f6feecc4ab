"""Registered queries, independent SQL for them, and the comparison of both."""
