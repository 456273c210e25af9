"""Detection and redaction of streams."""
