"""aerolith.streaming"""
