"""textquarry: duplicate-copy and corpus analytics expressed as Spark plans."""
