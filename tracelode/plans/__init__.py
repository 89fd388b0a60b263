"""Plans of tracelode."""
