"""Views over base tables."""
