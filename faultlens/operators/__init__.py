"""Relational, graph, model and diagnosis operators."""
