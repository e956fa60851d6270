"""Part of passplane; see README."""
