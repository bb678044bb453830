"""Records without a schema: text of JSON as VARIANT, and from there to typed columns with dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.sources.stages import stored


def _parts(inside: str) -> list[str]:
    """The text at its commas outside brackets and quotes."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(inside):
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                out.append(inside[last:i])
                last = i + 1
    return [x.strip() for x in [*out, inside[last:]] if x.strip()]


def leaves(kind: str, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """Path and type of each field of a type as schema_of_variant_agg says it; objects are opened, arrays are not."""
    if not kind.startswith("OBJECT<"):
        return [(path, kind)] if path else []
    out = []
    for part in _parts(kind[len("OBJECT<") : -1]):
        if part.startswith("`"):
            end = part.index("`:", 1) if "`:" in part else part.index("`", 1)
            name, rest = part[1:end].replace("``", "`"), part[end + 1 :].lstrip(": ")
        else:
            name, _, rest = part.partition(":")
        out += leaves(rest.strip(), (*path, name.strip()))
    return out


def _field(record: Column, path: tuple[str, ...], kind: str) -> Column:
    at = "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)
    if kind in ("VOID",):
        return F.lit(None).cast("string")
    if kind.startswith("ARRAY<") or kind in ("VARIANT", "OBJECT<>"):
        return F.to_json(F.try_variant_get(record, at, "variant"))
    return F.try_variant_get(record, at, kind.lower())


def observed_type(records: DataFrame, column: str) -> str:
    """The one type that all records of a VARIANT column have; fields of several types are VARIANT or a wider type."""
    return records.agg(F.schema_of_variant_agg(column)).first()[0] or "VOID"


def typed(records: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """records with a text column of JSON replaced by a typed column for each field that any record has, named by its
    path with dots; lists and fields of mixed types are JSON text.

    The fields are found over all records, unless kind (a type as observed_type gives it) says them. A null, empty or
    broken text has null fields, as have records without the field; columns of records keep their names, and a field
    named like one of them gets the column's name and a dot before its own. A field whose name holds both kinds of quotes
    can't be reached and is left out. A table without any object gets no columns.
    """
    rest = [c for c in records.columns if c != column]
    parsed = records.withColumn(column, F.try_parse_json(column))
    if kind is None:
        parsed = stored(parsed, "records")
        kind = observed_type(parsed, column)
    found = [(path, k) for path, k in leaves(kind) if not any("'" in p and '"' in p for p in path)]
    fields = [(".".join(path), _field(F.col(f"`{column}`"), path, k)) for path, k in found]
    taken = {c.lower() for c in rest}
    return parsed.select(*(F.col(f"`{c}`") for c in rest), *(value.alias(f"{column}.{name}" if name.lower() in taken else name) for name, value in fields))
