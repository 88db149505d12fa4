"""Campaign steps over streams."""
