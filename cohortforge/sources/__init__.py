"""Scans of the supported file formats, and the stores written by the verbs.

Text formats are read line by line with a per-file ordinal, so a file is never
held as one row and a splittable file is read by many tasks.
"""
