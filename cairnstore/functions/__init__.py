"""Column functions: paths, sizes, names, hashes, codecs, encryption."""
