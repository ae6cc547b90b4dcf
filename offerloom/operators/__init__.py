"""DataFrame -> DataFrame operators of the price comparison."""
