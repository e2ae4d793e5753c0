"""Training-corpus operators over a ``documents`` table."""
