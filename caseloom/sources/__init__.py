"""Readers and writers: event logs, fitted models, result tables."""
