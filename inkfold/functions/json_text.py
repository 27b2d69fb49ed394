"""JSON columns parsed the strict way: a text is one whole object, or it is bad."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_BARE = "w STRING, end BOOLEAN, _bad STRING"
_OPTIONS = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def parse_object(text: Column, schema: T.StructType) -> Column:
    """``STRUCT<w ARRAY<schema>, end BOOLEAN, _bad STRING, alone BOOLEAN>`` of a JSON object text.

    ``from_json`` by itself stops at the end of the first value, so junk after it
    would pass.  Reading the text as the only element of an array, with a marker
    behind it, makes the parser look at every character.  A text that closes the array
    itself (``{..}],"x":[{..}``) would still pass, so it must also stand without the
    array: breaking out of one wrapper breaks the other.  The second parse runs only
    where a ``]`` is followed by a comma.  Use :func:`is_object` and :func:`the_object`
    on a column holding the result.
    """
    wrapped = T.StructType(
        [
            T.StructField("w", T.ArrayType(schema)),
            T.StructField("end", T.BooleanType()),
            T.StructField("_bad", T.StringType()),
        ]
    )
    parsed = F.from_json(F.concat(F.lit('{"w":['), text, F.lit('],"end":true}')), wrapped, _OPTIONS)
    bare = F.from_json(F.concat(F.lit('{"w":'), text, F.lit(',"end":true}')), _BARE, _OPTIONS)
    alone = F.when(text.rlike(r"\]\s*,"), bare["_bad"].isNull() & F.coalesce(bare["end"], F.lit(False))).otherwise(True)
    return F.struct(
        parsed["w"].alias("w"), parsed["end"].alias("end"), parsed["_bad"].alias("_bad"), alone.alias("alone")
    )


def is_object(parsed: Column) -> Column:
    """True where the text was exactly one object of the asked shape (never NULL)."""
    return F.coalesce(
        parsed["_bad"].isNull()
        & parsed["end"]
        & parsed["alone"]
        & (F.size(parsed["w"]) == 1)
        & F.get(parsed["w"], F.lit(0)).isNotNull(),
        F.lit(False),
    )


def the_object(parsed: Column) -> Column:
    return F.get(parsed["w"], F.lit(0))


def to_json_text(struct: Column) -> Column:
    """JSON text that keeps null fields, so that the keys of a message never vary."""
    return F.to_json(struct, {"ignoreNullFields": "false"})
