"""axiomill.operators"""
