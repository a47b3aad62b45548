"""axiomill.plans"""
