"""Analytics over collections of fraud-related documents, as Spark plans."""
