"""axiomill.streaming"""
