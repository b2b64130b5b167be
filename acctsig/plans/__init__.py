"""acctsig.plans."""
