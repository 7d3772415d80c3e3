"""crawlscan: a PySpark-native analytics engine for web-crawl archives."""
