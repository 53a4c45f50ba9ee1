"""Analytics over coloured, part-labelled point sets on Spark."""
