"""DataFrame-to-DataFrame steps shared by plans."""
