"""Part of volatide; see README.md."""
