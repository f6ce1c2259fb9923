"""DataFrame-to-DataFrame verbs."""
