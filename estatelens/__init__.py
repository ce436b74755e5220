"""Analytics over estates of automation scripts and their documentation, on Spark."""
