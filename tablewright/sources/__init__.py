"""Reading, registering, describing, exporting and versioning datasets."""
