"""Operators for building training corpora: codecs, joins, mixing, search, scans."""
