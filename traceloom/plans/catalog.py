"""Registry of named queries and their independent SQL oracles."""

from ..session import tune

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register a query; `oracle` is SQL for DuckDB over the same parquet tables."""

    def register(build):
        def run(spark, sf_dir):
            return build(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def load():
    from . import (  # noqa: F401
        commit,
        documents,
        evidence,
        graph,
        places,
        resolution,
        revisions,
        runs,
        shares,
        sources,
        streams,
    )

    return QUERIES, ORACLES
