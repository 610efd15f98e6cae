"""Analytics over conversation and knowledge-record corpora, as Spark jobs."""
