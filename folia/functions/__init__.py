"""folia."""
