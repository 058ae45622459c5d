"""voxelspark sub-package."""
