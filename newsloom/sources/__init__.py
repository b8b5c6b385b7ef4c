"""Readers: feed documents, crawl tables, the ticker dictionary, topics and scored tables."""
