"""Readers: folders of files, pictures, and catalogues built from tables."""
