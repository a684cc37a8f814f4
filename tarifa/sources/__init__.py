"""tarifa.sources."""
