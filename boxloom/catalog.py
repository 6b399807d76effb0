"""Every query of the core by name, with the SQL that checks it."""

from __future__ import annotations

from boxloom.operators import heavy_keys, referential
from boxloom.plans import dataset, detection

FLAGSHIP = "prf_per_class"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (detection, dataset, heavy_keys, referential):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
