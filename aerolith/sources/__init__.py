"""aerolith.sources"""
