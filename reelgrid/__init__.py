"""Analytics over multi-camera recordings and the playout built from them, as Spark tables and streams."""
