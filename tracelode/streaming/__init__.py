"""Streaming of tracelode."""
