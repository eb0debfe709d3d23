"""Part of textquarry."""
