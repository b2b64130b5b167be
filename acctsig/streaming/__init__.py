"""acctsig.streaming."""
