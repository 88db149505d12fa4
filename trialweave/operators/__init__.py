"""Samplers, runners, expansion and surrogate models."""
