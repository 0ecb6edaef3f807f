"""Search, match and relate large catalogs of named things with Spark."""
