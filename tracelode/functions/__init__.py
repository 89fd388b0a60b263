"""Functions of tracelode."""
