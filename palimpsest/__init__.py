"""Analytics over conversational memory data, as Spark plans."""
