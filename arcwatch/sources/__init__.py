"""Readers that give the record types of the detectors."""
