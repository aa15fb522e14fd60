"""Schemas of the index tables and the codes of entry types."""

from pyspark.sql import types as T

INDEX, TERM, PAGE = 0, 1, 2
TYPE_NAMES = {INDEX: "INDEX", TERM: "TERM", PAGE: "PAGE"}
FORMAT_VERSION = 1

_KINDS = {
    "string": T.StringType(), "tinyint": T.ByteType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "array<int>": T.ArrayType(T.IntegerType()), "array<string>": T.ArrayType(T.StringType()), "map<int,string>": T.MapType(T.IntegerType(), T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct(**fields: str | T.DataType) -> T.StructType:
    """A schema made without a session."""
    return T.StructType([T.StructField(n, _KINDS[k] if isinstance(k, str) else k) for n, k in fields.items()])


POSTINGS = struct(term="string", entry_type="tinyint", target="string", title="string", rel="double", tf="int", positions="array<int>", fragments="map<int,string>", site="string", edition="bigint")
META = struct(name="string", owner="string", owner_email="string", total_pages="bigint", modified="timestamp", format_version="int", extra="map<string,string>")
URIS = struct(uri_key="string", uri="string", qual="float", date_checked="timestamp", title="string", size="int", type="string", terms="array<string>")
REGISTRY = struct(alias="string", location="string", edition="bigint")

#: An entry is one and the same when these agree; a target is when the last two do.  Title and positions do not count.
IDENTITY = ["term", "entry_type", "target", "rel"]
TARGET = ["entry_type", "target"]
