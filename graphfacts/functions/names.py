"""Names of types and methods in source form and in virtual-machine form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One-letter codes of the primitive types.
PRIMITIVES = {
    "boolean": "Z",
    "byte": "B",
    "char": "C",
    "double": "D",
    "float": "F",
    "int": "I",
    "long": "J",
    "short": "S",
    "void": "V",
}
TYPE = r"\[*(?:[BCDFIJSVZ]|L[^;]+;)"


def _switch(column: Column, mapping: dict[str, str], otherwise: Column) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(otherwise)


def to_machine(source: Column) -> Column:
    """``java.lang.String`` → ``Ljava/lang/String``, ``int`` → ``I``, ``int[]`` → ``[I``."""
    dims = F.regexp_count(source, F.lit(r"\[\]"))
    base = F.regexp_replace(source, r"\[\]", "")
    return F.concat(F.repeat(F.lit("["), dims), _switch(base, PRIMITIVES, F.concat(F.lit("L"), F.translate(base, ".", "/"))))


def to_source(machine: Column) -> Column:
    """Inverse of :func:`to_machine`; a closing semicolon is accepted."""
    base = innermost(machine)
    plain = F.translate(F.regexp_replace(F.regexp_replace(base, "^L", ""), ";$", ""), "/", ".")
    return F.concat(_switch(base, {v: k for k, v in PRIMITIVES.items()}, plain), F.repeat(F.lit("[]"), dimension(machine)))


def return_type(descriptor: Column) -> Column:
    """Type after the closing parenthesis, without a final semicolon."""
    return F.regexp_replace(F.regexp_extract(descriptor, r"\)(.*)$", 1), ";$", "")


def parameter_types(descriptor: Column) -> Column:
    """Array of parameter types, without final semicolons."""
    inside = F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(f"({TYPE})"), 1), lambda t: F.regexp_replace(t, ";$", ""))


def dimension(name: Column) -> Column:
    return F.length(F.regexp_extract(name, r"^(\[*)", 1))


def innermost(name: Column) -> Column:
    """Element type of an array type, the type itself otherwise."""
    return F.regexp_replace(name, r"^\[+", "")


def package(name: Column) -> Column:
    """``Ljava/lang/String`` → ``java/lang``; null in the default package and for primitives."""
    return F.nullif(F.regexp_extract(name, r"^\[*L(.*)/[^/]*$", 1), F.lit(""))


def class_name(name: Column) -> Column:
    """``Ljava/lang/String`` → ``String``."""
    return F.regexp_replace(F.regexp_replace(innermost(name), r"^L?(?:.*/)?", ""), ";$", "")


def is_primitive(name: Column) -> Column:
    return F.coalesce(name.rlike("^[BCDFIJSVZ]$"), F.lit(False))


SIGNATURE = r"^(.*)\.([^.(]+)(\(.*)$"


def signature_class(signature: Column) -> Column:
    """``a.b.C.m(I)V`` → ``a.b.C``."""
    return F.regexp_extract(signature, SIGNATURE, 1)


def signature_name(signature: Column) -> Column:
    return F.regexp_extract(signature, SIGNATURE, 2)


def signature_descriptor(signature: Column) -> Column:
    return F.regexp_extract(signature, SIGNATURE, 3)


def slash_to_dot(name: Column) -> Column:
    return F.translate(name, "/", ".")


def dot_to_slash(name: Column) -> Column:
    return F.translate(name, ".", "/")


def dollar_to_dot(name: Column) -> Column:
    """Nested classes written with a dot."""
    return F.translate(name, "$", ".")


def remove_package(name: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(name, ".", -1)


def top_level_type(name: Column) -> Column:
    """Name up to the first dollar sign."""
    return F.substring_index(name, "$", 1)
