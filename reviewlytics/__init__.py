"""Review-rating analytics as Spark jobs.

Layers, bottom up:

* ``functions``: column expressions (cleaning, rounding, text).
* ``operators``: DataFrame operators (seed matching, bounded lookups, ids, table upkeep).
* ``sources``: readers and writers for review files, raw CSVs and the five tables.
* ``plans``: the queries a caller runs (scoring, views, search, mining).
"""

from reviewlytics.schema import Model

__all__ = ["Model"]
