"""Operators that prepare language-model training data from crawled pages and documents."""
