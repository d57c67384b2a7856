"""Arrow functions on text columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


@arrow_udf(StringType())
def lower_sha256(text: pa.Array) -> pa.Array:
    """SHA-256 (hex) of the UTF-8 text after lower-casing A-Z only; null counts as empty."""
    lowered = pc.ascii_lower(pc.fill_null(text, "")).cast(pa.binary())
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in lowered])
