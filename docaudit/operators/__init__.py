"""DataFrame-to-DataFrame operators over whole corpora."""
