"""Versioned dataset contracts: model, registry, types."""
