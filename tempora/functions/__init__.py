"""See the README for the map of this package."""
