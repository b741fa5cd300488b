"""golode: executable-metadata analytics on Spark."""
