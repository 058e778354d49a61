"""aerolith.operators"""
