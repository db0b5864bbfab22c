"""strataforge.sources"""
