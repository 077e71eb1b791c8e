"""Training-data preparation operators.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
