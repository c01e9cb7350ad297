"""Search specifications and the lazy plans built from them."""
