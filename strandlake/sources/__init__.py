"""Readers and writers of annotation, sequence and variant files."""
