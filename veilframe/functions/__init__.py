"""Column functions, and the pure text routines behind Arrow UDFs."""
