"""acctsig.functions."""
