"""Fixed catalogues, and the queries registered with the driver."""
