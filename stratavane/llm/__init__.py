"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; it may be deleted as a whole.  Code that
runs on executors travels with the job, so the package needs no installation there.
"""

from pyspark import cloudpickle

import stratavane.llm as _self

cloudpickle.register_pickle_by_value(_self)
