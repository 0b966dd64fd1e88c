"""Reports and the catalogue of registered queries."""
