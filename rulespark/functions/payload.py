"""Payloads as VARIANT: JSON text is parsed once, and its fields are read by their type hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.schema import NO, YES

#: A plain number, also with thousands and a sign of currency in front.
NUMBER = r"^[+-]?(?:[$€£] ?)?(?:\d{1,3}(?:,\d{3})+|\d+|(?=\.\d))(?:\.\d*)?(?:[eE][+-]?\d+)?$"
KINDS = {"bool": "boolean", "numeric": "double"}


def boolean(text: Column) -> Column:
    """True or false for the texts that mean yes and no in any case; else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def number(text: Column) -> Column:
    """The number that the text is; null for any other text and for numbers beyond a double."""
    clean = F.trim(text)
    value = F.when(clean.rlike(NUMBER), F.regexp_replace(clean, "[$€£ ,]", "").try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def typed(text: Column, hint: str) -> Column:
    """The text by its type hint: a boolean for ``bool``, a double for ``numeric``, else the text without outer spaces; null if blank."""
    return boolean(text) if hint == "bool" else number(text) if hint == "numeric" else F.nullif(F.trim(text), F.lit(""))


def place(name: str) -> str:
    """The path of a field."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a field's name has both quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def text_of(payload: Column, name: str) -> Column:
    """A field as text: numbers and booleans as JSON writes them, arrays and objects as JSON; null if absent or null."""
    return F.try_variant_get(payload, place(name), "string")


def field(payload: Column, name: str, hint: str) -> Column:
    """A field by its type hint; the text of a number or boolean of JSON is read as that."""
    return typed(text_of(payload, name), hint)


def held(text: Column, kind: Column) -> Column:
    """The text as VARIANT of the kind (a type hint) that is told in the row; text that its kind cannot hold stays text."""
    own = F.when(kind == "bool", boolean(text).cast("variant")).when(kind == "numeric", number(text).cast("variant"))
    return F.coalesce(own, text.cast("variant"))


def faults(read: list[tuple[str, Column, Column, str]]) -> Column:
    """array<struct<field,value,reason>> of (name, text, typed value, hint): filled texts that their type cannot hold."""
    kind = lambda hint: KINDS.get(hint, "text")
    one = lambda name, text, value, hint: F.when((F.trim(text) != "") & value.isNull(), F.struct(F.lit(name).alias("field"), text.alias("value"), F.lit(f"not a {kind(hint)}").alias("reason")))
    none = F.lit(None).cast("struct<field:string,value:string,reason:string>")
    return F.array_compact(F.array(*[one(*r) for r in read], none))


def parsed(df: DataFrame, text: str, name: str = "payload") -> DataFrame:
    """The table with the JSON text of a column as VARIANT and ``{name}_error``, why there is none; the text stays.

    A payload is a JSON object. Blank text, text that is no JSON (a name twice in one object included)
    and JSON of another kind have a null payload and a reason; a null has neither.
    """
    body = F.col(f"`{text}`").cast("string")
    out = df.withColumn(name, F.try_parse_json(body))
    value = F.col(f"`{name}`")
    object_ = body.rlike(r"^[ \t\r\n]*\{")
    why = F.when(F.trim(body) == "", "blank").when(body.isNotNull() & value.isNull(), "not JSON").when(body.isNotNull() & ~object_, "not an object")
    return out.withColumn(f"{name}_error", why).withColumn(name, F.when(object_, value))


def read(df: DataFrame, text: str, hints: dict[str, str], name: str = "payload") -> DataFrame:
    """``parsed`` with a column for each field of ``hints`` (name: type hint) and ``field_errors``, the fields that cannot be read.

    Columns of these names are replaced. A row without a payload has null fields and no field errors.
    """
    out = parsed(df, text, name)
    value = F.col(f"`{name}`")
    listed = [(n, text_of(value, n), field(value, n, h), h) for n, h in hints.items()]
    return out.withColumns({n: v for n, _, v, _ in listed} | {"field_errors": faults(listed)})
