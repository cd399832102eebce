"""Extension points (X1 fetch drivers, X1b named fetcher instances, X2 response templates, X3 block filters).

Registries live on the driver; what reaches the plan is a literal map (fetcher name -> driver) or a DataFrame
transform, never per-row Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.model import JobConfig, message

# A driver takes the rows routed to it (request_id, params, plus any other columns) and the instance options, and
# returns the same rows with ``data`` (binary) and ``fetch_error`` (string, NULL on success) added.
FetchDriver = Callable[[DataFrame, dict], DataFrame]
TemplateFn = Callable[[Column, Column], Column]
BlockFilter = Callable[[DataFrame], DataFrame]
RowFilter = Callable[[Column], Column]

_DRIVERS: dict[str, FetchDriver] = {}
_ROW_DRIVERS: dict[str, Callable] = {}
_TEMPLATES: dict[str, TemplateFn] = {}
_FILTERS: dict[str, RowFilter] = {}


class RegistryError(ValueError):
    pass


def register_fetcher(name: str, fn: FetchDriver, row_fn: Callable | None = None) -> None:
    """Empty name, missing function and duplicate name are errors.

    ``row_fn(params: Column, options)`` optionally gives the same driver as a struct column (data, error), or the two as a
    tuple; such drivers need no join and are evaluated together in one projection by ``dispatch_fetch``. With options that it
    cannot serve without a join it returns None."""
    if not name:
        raise RegistryError(message("driver_name_empty"))
    if fn is None:
        raise RegistryError(message("driver_fn_nil", name=name))
    if name in _DRIVERS:
        raise RegistryError(message("driver_exists", name=name))
    _DRIVERS[name] = fn
    if row_fn is not None:
        _ROW_DRIVERS[name] = row_fn


def row_driver(name: str) -> Callable | None:
    return _ROW_DRIVERS.get(name)


def fetch_driver(name: str) -> FetchDriver:
    if name not in _DRIVERS:
        raise RegistryError(message("driver_missing", name=name))
    return _DRIVERS[name]


def drivers() -> dict[str, FetchDriver]:
    return dict(_DRIVERS)


def configure_fetchers(conf: JobConfig) -> dict[str, str]:
    """Named fetcher instances over drivers. Name may not be '' or 'default', must be unique, driver required
    and registered. Returns name -> driver."""
    import quire.sources.fetch  # noqa: F401  (registers the built-in drivers)

    out: dict[str, str] = {}
    for name, fc in conf.fetchers:
        if not name or name == "default":
            raise RegistryError(message("instance_name_bad"))
        if name in out:
            raise RegistryError(message("instance_exists", name=name))
        if not fc.driver:
            raise RegistryError(message("instance_driver_empty", name=name))
        fetch_driver(fc.driver)
        out[name] = fc.driver
    return out


def driver_of(name: Column, conf: JobConfig) -> Column:
    """Fetcher instance name -> driver name (NULL when unknown), as a literal map in the plan (no join)."""
    names = configure_fetchers(conf)
    if not names:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return F.try_element_at(m, name)


def registry_frame(spark: SparkSession, conf: JobConfig) -> DataFrame:
    """The registry as a (tiny, config-bounded) DataFrame, for reporting and joins."""
    rows = sorted(configure_fetchers(conf).items())
    return spark.createDataFrame(rows, "name string, driver string")


def register_template(name: str, fn: TemplateFn) -> None:
    """A bad template fails at registration, not per row."""
    if not name:
        raise RegistryError("template name is empty")
    if not callable(fn):
        raise RegistryError(f"template {name} is not callable")
    if name in _TEMPLATES:
        raise RegistryError(f"template {name} already exist")
    _TEMPLATES[name] = fn


def templates() -> dict[str, TemplateFn]:
    return dict(_TEMPLATES)


def register_filter(name: str, fn: RowFilter) -> None:
    """X3 inside the conversion job: ``fn`` takes and gives a document's block array (a column). A request whose ``filter``
    option is ``name`` goes through it when the job enables filters."""
    if not name:
        raise RegistryError("filter name is empty")
    if not callable(fn):
        raise RegistryError(f"filter {name} is not callable")
    if name in _FILTERS:
        raise RegistryError(f"filter {name} already exist")
    _FILTERS[name] = fn


def filters() -> dict[str, RowFilter]:
    return dict(_FILTERS)


def block_filter(blocks: DataFrame, fn: BlockFilter | None, enabled: bool) -> DataFrame:
    """A user transform over the block table, applied only when the job enables filters."""
    if fn is None or not enabled:
        return blocks
    out = blocks.transform(fn)
    missing = {"doc_id", "block_no", "kind", "level", "text"} - set(out.columns)
    if missing:
        raise RegistryError(f"block filter dropped columns {sorted(missing)}")
    return out
