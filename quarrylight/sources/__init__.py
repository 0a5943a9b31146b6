"""Adapters that turn external shapes into rows."""
