"""tarifa.streaming."""
