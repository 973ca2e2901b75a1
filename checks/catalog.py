"""All registered queries and their SQL."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

import feedfold

from . import digests, exports, feeds, stored, streams, texts

# Functions sent to Python workers travel by value: the package need not be
# installed there.
cloudpickle.register_pickle_by_value(feedfold)
cloudpickle.register_pickle_by_value(sys.modules["checks"])

QUERIES: dict = {}
ORACLES: dict = {}
for module in (feeds, texts, digests, stored, exports, streams):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
