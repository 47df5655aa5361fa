"""Where facts come from."""
