"""Sources of tracelode."""
