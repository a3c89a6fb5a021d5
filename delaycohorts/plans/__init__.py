"""Studies and registered queries composed from the operators."""
