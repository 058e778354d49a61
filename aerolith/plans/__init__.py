"""aerolith.plans"""

from . import catalog, files, products  # noqa: F401  (files and products add their queries to the catalogue)
