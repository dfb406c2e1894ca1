"""See the package docstring of fathomline."""
