"""strataforge.plans"""
