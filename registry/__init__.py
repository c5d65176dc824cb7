"""The library's operators wired to the given tables, each with its SQL twin."""

from registry import (comparison, corpus, evaluation, folds, linkage, models, profile, scoring,  # noqa: F401
                      sources, streams)
from registry.base import ORACLES, QUERIES  # noqa: F401
