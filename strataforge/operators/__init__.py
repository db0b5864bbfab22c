"""strataforge.operators"""
