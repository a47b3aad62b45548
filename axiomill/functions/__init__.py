"""axiomill.functions"""
