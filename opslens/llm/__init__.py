"""Operators of a training-data pipeline over documents, embeddings and conversations.

Nothing outside this subpackage imports it; ``opslens.llm.queries`` lists its queries.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get the functions of these modules with the tasks; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
