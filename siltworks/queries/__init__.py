"""siltworks.queries"""
