"""Whole plans: detection, redaction, restoring and their reports."""
