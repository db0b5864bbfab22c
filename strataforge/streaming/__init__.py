"""strataforge.streaming"""
