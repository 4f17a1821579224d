"""How sequences and indexes are laid out and built."""
