"""Training-data operators: dedup, search, packing, mixing, archives and text classifiers."""
