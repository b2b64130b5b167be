"""acctsig.operators."""
