"""Part of curatrix; see the README."""
