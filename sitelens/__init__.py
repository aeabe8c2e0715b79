"""sitelens: web-crawl analytics as DataFrame operators on Apache Spark."""
