"""DataFrame operators, written for use with ``DataFrame.transform``."""
