"""Readers, writers and the extraction jobs over stored responses."""
