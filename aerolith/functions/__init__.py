"""aerolith.functions"""
