"""Readers of scene files. A file is one row of Spark's binaryFile source; parsing runs on the executors."""
