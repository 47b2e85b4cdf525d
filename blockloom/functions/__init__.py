"""Scalar functions: the gzip format's fields, hashes, checksums, names and sizes."""
