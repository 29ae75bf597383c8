"""Graphloom: property-graph, search and corpus analytics as ordinary Spark plans."""
