"""Part of the cell-population analytics library."""
