"""Housing, finance, portal and repair operators."""
