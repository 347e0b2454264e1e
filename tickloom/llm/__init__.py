"""Operators of a training-data pipeline; nothing else in the package imports this folder."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# functions sent to executors carry this folder's code with them, so that nothing needs installing there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load():
    """Registered queries of this folder and their SQL texts."""
    from tickloom.llm import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)
