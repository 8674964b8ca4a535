"""Training-data operators: language ID, near-duplicate and substring dedup,
exact top-k search, packing, toxicity, PII pseudonyms, line dedup, URL filters
and benchmark decontamination. Nothing outside this subpackage imports it."""
import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their code: executors need no
# installed copy of this subpackage.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
