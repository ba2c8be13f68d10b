"""Arrow types of Spark schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string (call on the driver; the result travels with the function)."""
    return to_arrow_schema(StructType.fromDDL(ddl))
