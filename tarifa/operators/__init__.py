"""tarifa.operators."""
