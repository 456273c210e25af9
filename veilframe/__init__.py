"""Finding and reversibly masking sensitive values in columns of text."""
