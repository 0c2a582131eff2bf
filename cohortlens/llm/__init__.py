"""Training-data operators: de-duplication, packing, token files, archives, extraction, scoring.

Nothing else in the library imports this subpackage.
"""
