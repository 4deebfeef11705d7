"""Incremental use of the batch jobs: a finalised run as one micro-batch."""
