"""lexidx: versioned, verified full-text index tables built with Spark.

Document tables (or NDJSON files) go in; stored-document, postings, point,
term and length tables come out, published per version with a manifest.
Catalog and lifecycle state are tables too, folded by batch or streaming jobs.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers (the streaming state machine, the
# lifecycle fold, the training-data operators) are shipped by value, so
# workers need no import path to this package (it may only be on the
# driver's sys.path; on a cluster --py-files works as well).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from lexidx.operators.schema import Field, FieldType  # noqa: E402,F401
from lexidx.session import build_session, scratch_path  # noqa: E402,F401
