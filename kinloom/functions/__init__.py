"""Column functions and the one Arrow UDF that Unicode normalisation needs."""
