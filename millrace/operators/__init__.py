"""All built-in operators; importing this package registers them."""

from millrace.operators import basic, dedup, filters, models, reduce, text, tokens, web
from millrace.sources import readers, warc, writers

__all__ = ["basic", "dedup", "filters", "models", "reduce", "text", "tokens", "web", "readers", "warc", "writers"]
