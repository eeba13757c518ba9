"""Readers and writers of samples, rules, routing and measurements."""
