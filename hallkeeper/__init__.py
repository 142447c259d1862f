"""Student-housing analytics as set-based PySpark operators.

Every operator is a pure function ``(tables, parameters) -> DataFrame`` over a
:class:`hallkeeper.tables.Tables` mapping. Reference dates are parameters.
"""

from hallkeeper.tables import Tables

__all__ = ["Tables"]
