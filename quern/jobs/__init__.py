"""Runs over splits: checkpoints, locks, reports."""
