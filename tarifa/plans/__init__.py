"""tarifa.plans."""
