"""Named queries with their SQL twins."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame`, with SQL giving the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
