"""Typed readers: catalogs, image files, registry documents, uploads."""
