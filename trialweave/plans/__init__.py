"""Configurations, campaigns and registered queries."""
