"""Column types: names, Spark types, and the checks Spark's types don't make.

``TypeSpec`` keeps the declared type for good; only its Spark form is physical.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names without parameters, with the least and most value where the Spark type is wider.
PLAIN: dict[str, tuple[T.DataType, tuple[int, int] | None]] = {
    "BOOLEAN": (T.BooleanType(), None), "TINYINT": (T.ByteType(), None), "SMALLINT": (T.ShortType(), None), "INTEGER": (T.IntegerType(), None), "BIGINT": (T.LongType(), None),
    "HUGEINT": (T.DecimalType(38, 0), None), "UTINYINT": (T.ShortType(), (0, 2**8 - 1)), "USMALLINT": (T.IntegerType(), (0, 2**16 - 1)), "UINTEGER": (T.LongType(), (0, 2**32 - 1)), "UBIGINT": (T.DecimalType(20, 0), (0, 2**64 - 1)),
    "FLOAT": (T.FloatType(), None), "DOUBLE": (T.DoubleType(), None), "VARCHAR": (T.StringType(), None), "BLOB": (T.BinaryType(), None), "DATE": (T.DateType(), None),
    "TIME": (T.LongType(), (0, 86_400_000_000 - 1)), "TIMESTAMP": (T.TimestampNTZType(), None), "INTERVAL": (T.DayTimeIntervalType(), None), "VARIANT": (T.VariantType(), None),
    "UUID": (T.StringType(), None), "JSON": (T.StringType(), None), "ENUM": (T.StringType(), None),
}


@dataclass(frozen=True)
class TypeSpec:
    """A declared type: a name, and its parameters or children."""

    name: str
    params: tuple[int, ...] = ()
    children: tuple[tuple[str, TypeSpec], ...] = ()

    def spark(self) -> T.DataType:
        kids = [c.spark() for _, c in self.children]
        if self.name == "DECIMAL":
            return T.DecimalType(*self.params)
        if self.name in ("LIST", "ARRAY"):
            return T.ArrayType(kids[0])
        if self.name == "STRUCT":
            return T.StructType([T.StructField(n, k) for (n, _), k in zip(self.children, kids)])
        if self.name == "MAP":
            return T.MapType(*kids)
        return PLAIN[self.name][0]

    def __str__(self) -> str:
        if self.name == "DECIMAL":
            return f"DECIMAL({self.params[0]},{self.params[1]})"
        if self.name == "LIST":
            return f"LIST({self.children[0][1]})"
        if self.name == "ARRAY":
            return f"ARRAY({self.children[0][1]},{self.params[0]})"
        if self.name == "STRUCT":
            return f"STRUCT({', '.join(f'{n} {c}' for n, c in self.children)})"
        if self.name == "MAP":
            return f"MAP({self.children[0][1]}, {self.children[1][1]})"
        return self.name

    def check(self, col: Column) -> Column | None:
        """True where a value breaks the type; None if the Spark type says it all."""
        if self.name == "ARRAY":
            inner = self.children[0][1].check(F.lit(None).cast(self.children[0][1].spark()))
            wrong = F.size(col) != self.params[0]
            return F.coalesce(wrong | (F.exists(col, lambda x: F.coalesce(self.children[0][1].check(x), F.lit(False))) if inner is not None else F.lit(False)), F.lit(False)) & col.isNotNull()
        if self.name in ("LIST",):
            if self.children[0][1].check(F.lit(None).cast(self.children[0][1].spark())) is None:
                return None
            return F.coalesce(F.exists(col, lambda x: F.coalesce(self.children[0][1].check(x), F.lit(False))), F.lit(False))
        if self.name == "STRUCT":
            parts = [p for n, c in self.children if (p := c.check(col.getField(n))) is not None]
            out = None
            for p in parts:
                out = p if out is None else out | p
            return out
        bounds = PLAIN.get(self.name, (None, None))[1]
        return None if bounds is None else F.coalesce(~col.between(F.lit(bounds[0]), F.lit(bounds[1])), F.lit(False))


def _split(text: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]]]


def parse_type(text: str) -> TypeSpec:
    """The type of a name such as ``DECIMAL(10,2)`` or ``STRUCT(a INTEGER, b LIST(VARCHAR))``."""
    text = text.strip()
    m = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", text, re.DOTALL)
    if not m:
        raise ValueError(f"not a type: {text!r}")
    name, inner = m[1].upper(), m[2]
    if name == "DECIMAL":
        width, scale = map(int, _split(inner)) if inner else (18, 3)
        if not 0 <= scale <= width or not 1 <= width <= 38:
            raise ValueError(f"DECIMAL({width},{scale}): 0 <= scale <= width <= 38 is asked for")
        return TypeSpec(name, (width, scale))
    if name == "LIST" and inner:
        return TypeSpec(name, (), (("element", parse_type(inner)),))
    if name == "ARRAY" and inner:
        element, size = _split(inner)
        return TypeSpec(name, (int(size),), (("element", parse_type(element)),))
    if name == "STRUCT" and inner:
        fields = [p.split(None, 1) for p in _split(inner)]
        return TypeSpec(name, (), tuple((n, parse_type(t)) for n, t in fields))
    if name == "MAP" and inner:
        key, value = _split(inner)
        return TypeSpec(name, (), (("key", parse_type(key)), ("value", parse_type(value))))
    if name not in PLAIN or inner:
        raise ValueError(f"unknown type: {text!r}")
    return TypeSpec(name)


def show_value(value: object) -> str:
    """A value as the table printer shows it."""
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"<blob:{len(value)} bytes>"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {show_value(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(show_value, value)) + "]"
    return str(value).lower() if isinstance(value, bool) else str(value)


def show_rows(columns: list[str], rows: list, most: int = 12, width: int = 40) -> str:
    """Rows as a table of text: numbers to the right, long cells cut, the middle of many rows left out."""
    shown = rows if len(rows) <= most else [*rows[: most // 2], *rows[len(rows) - (most - most // 2) :]]
    cut = lambda text: text if len(text) <= width else text[: width - 3] + "..."
    cells = [[cut(show_value(v).replace("\n", " ")) for v in r] for r in shown]
    widths = [max([3, len(c[:width]), *[len(r[i]) for r in cells]]) for i, c in enumerate(columns)]
    right = [bool(shown) and all(r[i] is None or isinstance(r[i], (int, float)) and not isinstance(r[i], bool) for r in shown) for i in range(len(columns))]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    out = [line, "|" + "|".join(f" {cut(c):<{w}} " for c, w in zip(columns, widths, strict=True)) + "|", line]
    for r in cells:
        out.append("|" + "|".join(f" {v:>{w}} " if to_right else f" {v:<{w}} " for v, w, to_right in zip(r, widths, right, strict=True)) + "|")
    out.append(line)
    if len(rows) > most:
        out.append(f"... {len(rows) - most} rows left out ...")
    return "\n".join([*out, f"({len(rows)} rows)"])
