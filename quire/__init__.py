"""quire: bulk document conversion on Spark.

A conversion request is a row, a corpus is a DataFrame. Sources resolve request payloads by joins, documents are
split into an ordered block table, content operators are column expressions and windows over that table, and
results are re-assembled per document and wrapped into one outcome row per request.

Entry points: ``convert_job`` (batch), ``convert_stream`` (Structured Streaming), ``read_requests`` /
``read_requests_stream`` (sources), ``JobConfig`` (job settings); ``python -m quire convert|stream`` runs them.
"""

__version__ = "0.1.0"

__all__ = ["JobConfig", "FetcherConf", "convert_job", "convert_distinct", "convert_stream", "read_requests",
           "read_requests_stream", "register_fetcher", "register_template", "file_table", "crawl_from_pages"]


def __getattr__(name):
    """Lazy re-exports, so ``import quire`` does not start anything."""
    if name in ("JobConfig", "FetcherConf"):
        from quire import model
        return getattr(model, name)
    if name in ("convert_job", "convert_distinct"):
        from quire.plans import convert
        return getattr(convert, name)
    if name == "convert_stream":
        from quire.streaming.stream import convert_stream
        return convert_stream
    if name in ("read_requests", "read_requests_stream"):
        from quire.sources import requests
        return getattr(requests, name)
    if name in ("register_fetcher", "register_template"):
        from quire.plans import registry
        return getattr(registry, name)
    if name == "file_table":
        from quire.sources.files import file_table
        return file_table
    if name == "crawl_from_pages":
        from quire.sources.fetch import crawl_from_pages
        return crawl_from_pages
    raise AttributeError(name)
