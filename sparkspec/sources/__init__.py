"""Readers and writers of the instrument's file formats."""
