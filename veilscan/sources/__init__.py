"""Readers and writers: unit tables, value lists, baselines, reports, stores."""
