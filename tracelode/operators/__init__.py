"""Operators of tracelode."""
