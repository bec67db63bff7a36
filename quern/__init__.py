"""quern: ranked full-text retrieval and facet analytics expressed as Spark plans."""
