"""Part of folioweave."""
