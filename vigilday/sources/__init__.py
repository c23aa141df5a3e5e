"""Readers and writers: raw CSV logs, directory, answers, interim and result tables."""
