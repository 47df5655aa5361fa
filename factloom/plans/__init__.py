"""Watch graphs and the plans that run them."""
