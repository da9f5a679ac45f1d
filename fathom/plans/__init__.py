"""Registered queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
A query without an oracle entry has no SQL statement of its result (ALS,
streaming); it is checked by row count and by tests against brute force.
"""

from fathom.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from fathom.plans import web  # noqa: F401,E402  (registers)
from fathom.plans import net  # noqa: F401,E402
from fathom.plans import rec  # noqa: F401,E402
from fathom.plans import text  # noqa: F401,E402
from fathom.plans import sources  # noqa: F401,E402
from fathom.plans import streams  # noqa: F401,E402
from fathom.plans import packets  # noqa: F401,E402
