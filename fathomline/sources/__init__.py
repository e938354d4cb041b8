"""Where panels and catalogs come from."""
