"""Reading described datasets, graphs and media."""
