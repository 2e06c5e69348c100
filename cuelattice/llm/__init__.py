"""Training-data operators over the library's transcript records. Nothing else in the package imports this folder."""
