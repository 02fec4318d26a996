"""Training-data operators: scoring, filtering, near copies, formats, encoding, search, sharding.

Nothing else in the library imports this subpackage. ``queries`` lists the
registered queries; each operator has a module of its own.
"""
