"""Registered queries over the standard tables and their SQL counterparts."""
