"""All queries of the library over the driver's tables, with their SQL."""

from __future__ import annotations

from . import catalog, catalog_formats, catalog_geometry, catalog_surfaces, catalog_values

QUERIES = catalog.QUERIES | catalog_formats.QUERIES | catalog_geometry.QUERIES | catalog_surfaces.QUERIES | catalog_values.QUERIES
SQL = catalog.SQL | catalog_formats.SQL | catalog_geometry.SQL | catalog_surfaces.SQL | catalog_values.SQL
