"""Jobs put together from the operators, and the catalogue of queries over the driver tables."""
