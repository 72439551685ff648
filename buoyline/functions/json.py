"""Column expressions over parsed JSON (VARIANT) that follow the message rules.

The contract is written in terms of a dynamically typed language: a field is
"present" when its value is truthy, a number may arrive as text, ``true``
casts to 1.0. These helpers express those rules as JVM-side expressions, so
a message never leaves whole-stage code generation.

Two levels: ``members`` pulls every key a rule needs out of the parsed
payload in one pass (a struct of VARIANT members, NULL unless the payload is
an object); the ``v_*`` functions then work on one member VARIANT each, where
SQL NULL means "absent" and a VARIANT null means JSON ``null``. The
``(json, key)`` forms are conveniences for single lookups.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _path(key: str) -> str:
    # Keys of the contract are plain identifiers; quote anything else.
    if key.replace("_", "").isalnum():
        return f"$.{key}"
    return "$['" + key.replace("'", "\\'") + "']"


def members(json: Column, keys: Iterable[str]) -> Column:
    """Struct of the named members as VARIANT, extracted in one pass.

    NULL when the payload is not an object; inside it, an absent key is NULL.
    """
    fields = ",".join(f"`{k}`:variant" for k in keys)
    return F.try_variant_get(json, "$", f"struct<{fields}>")


def member(json: Column, key: str) -> Column:
    """The member ``key`` as VARIANT; SQL NULL when absent, VARIANT null for JSON null."""
    return F.try_variant_get(json, _path(key), "variant")


def json_type(value: Column) -> Column:
    """Type name of a VARIANT: STRING, BIGINT, DOUBLE, DECIMAL(p,s), BOOLEAN, VOID, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(value)


def is_object(json: Column) -> Column:
    return F.try_variant_get(json, "$", "map<string,variant>").isNotNull()


def is_number_type(type_name: Column) -> Column:
    return type_name.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | type_name.startswith(
        "DECIMAL"
    )


# --------------------------------------------------------------------------- rules on one member VARIANT


def v_present(v: Column) -> Column:
    """Present with a non-null value."""
    return v.isNotNull() & ~F.is_variant_null(v)


def v_truthy(v: Column) -> Column:
    """Truthiness: absent, null, "", 0, false, [] and {} are false; "0" and " " are true."""
    t = json_type(v)
    s = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (t == "VOID"), F.lit(False))
        .when(t == "STRING", s != "")
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(t.startswith("ARRAY"), s != "[]")
        .when(t.startswith("OBJECT"), s != "{}")
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True)))
    )


def v_text(v: Column) -> Column:
    """Member as text (numbers and booleans in their JSON spelling); NULL if absent or null."""
    return F.try_variant_get(v, "$", "string")


def v_float(v: Column) -> Column:
    """``float(value)``: numbers, numeric text and booleans cast; anything else NULL.

    Text has to be spelled as a decimal number: the cast alone would also take
    Java's suffixes and hexadecimal floats (``"22.4d"``, ``"0x1p3"``).
    """
    text = F.try_variant_get(v, "$", "string")
    foreign = (json_type(v) == "STRING") & ~text.rlike(FLOAT_TEXT)
    return F.when(F.coalesce(foreign, F.lit(False)), F.lit(None).cast("double")).otherwise(F.try_variant_get(v, "$", "double"))


def v_int(v: Column) -> Column:
    """``int(value)``: numbers truncate, integral text and booleans cast; "3.7" is NULL."""
    return F.try_variant_get(v, "$", "bigint")


def v_str(v: Column) -> Column:
    """``str(value)``: JSON null is ``None``, booleans ``True``/``False``; text as is."""
    t = json_type(v)
    b = F.try_variant_get(v, "$", "boolean")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(t == "VOID", F.lit("None"))
        .when(t == "BOOLEAN", F.when(b, F.lit("True")).otherwise(F.lit("False")))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def v_bool(v: Column) -> Column:
    """``bool(value)``: truthiness of a present member."""
    return F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(v_truthy(v))


def v_cast(v: Column, type_name: str) -> Column:
    """Cast a member by the spec type name; an unknown name means ``str``."""
    return {"int": v_int, "float": v_float, "bool": v_bool}.get(type_name, v_str)(v)


# --------------------------------------------------------------------------- single-lookup conveniences


def is_present(json: Column, key: str) -> Column:
    return v_present(member(json, key))


def truthy(json: Column, key: str) -> Column:
    return v_truthy(member(json, key))


def as_text(json: Column, key: str) -> Column:
    return F.try_variant_get(json, _path(key), "string")


def as_float(json: Column, key: str) -> Column:
    return v_float(member(json, key))


def as_int(json: Column, key: str) -> Column:
    return F.try_variant_get(json, _path(key), "bigint")


def as_str(json: Column, key: str) -> Column:
    return v_str(member(json, key))


def as_bool(json: Column, key: str) -> Column:
    return v_bool(member(json, key))


def cast_member(json: Column, key: str, type_name: str) -> Column:
    return v_cast(member(json, key), type_name)
