"""Relational algebra over annotated DataFrames."""

import sys

from pyspark import cloudpickle

from provframe.frame import Dedup, KFrame
from provframe.semirings import BX, NX, B, N, Semiring, Weight
from provframe.session import tune
from provframe.sources.annotate import annotate, from_terms

__all__ = [
    "B",
    "BX",
    "Dedup",
    "KFrame",
    "N",
    "NX",
    "Semiring",
    "Weight",
    "annotate",
    "from_terms",
    "tune",
]

# Functions of this package travel to Python workers by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
