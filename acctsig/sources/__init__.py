"""acctsig.sources."""
