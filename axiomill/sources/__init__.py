"""axiomill.sources"""
