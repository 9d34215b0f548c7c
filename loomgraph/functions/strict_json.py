"""JSON texts parsed to variants, refusing what only begins as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string that marks the end of a value; texts that hold it are refused.
_END = "\\u0001end\\u0001"


def _once(value: Column, use) -> Column:
    """use(value), with value computed once also where expressions are not shared."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def strict_json(text: Column) -> Column:
    """Variant of a text that is one JSON value as a whole, else null.

    Spark's parser stops after the first value and ignores what follows it. The text is therefore parsed once as the first
    of two elements of an array, of which the second is a mark: only a text that is one value leaves the mark in its place.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    own = _once(pair, lambda v: F.when((F.try_variant_get(v, "$[1]", "string") == "\x01end\x01") & (F.try_variant_get(v, "$[2]", "variant").isNull()), F.try_variant_get(v, "$[0]", "variant")))
    return F.when(~text.contains(_END), own)


def json_lines(lines: Column) -> Column:
    """Variants of lines that hold one JSON object each, null if any does not; one parse for all lines.

    The lines stand between marks in one array. All marks lie in their places of the array itself only if every line is one value.
    """
    objects = ~F.exists(lines, lambda x: ~F.coalesce(x.rlike(r"^\s*\{") & x.rlike(r"\}\s*$") & ~x.contains(_END), F.lit(False)))
    every = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.array_join(lines, f',"{_END}",'), F.lit(f',"{_END}"]'))), "$", "array<variant>")
    mark = lambda v, i: (i % 2 == 0) | (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")) == "\x01end\x01")
    good = lambda vs: (F.size(vs) == 2 * F.size(lines)) & F.forall(F.transform(vs, mark), lambda x: x)
    return F.when((F.size(lines) > 0) & objects, _once(every, lambda vs: F.when(good(vs), F.filter(vs, lambda v, i: i % 2 == 0))))


def json_kind(schema: Column) -> Column:
    """Type of a JSON value from its `schema_of_variant`: whole and fractional numbers differ, null for null and for arrays without any typed element."""
    named = F.regexp_replace(schema, r"DECIMAL\((19|[2-9]\d),0\)", "WHOLE")
    named = F.regexp_replace(named, r"DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT", "FRACTION")
    named = F.regexp_replace(named, "BIGINT", "WHOLE")
    general = F.when(~named.rlike(r"^(ARRAY<)*VOID>*$"), named)
    plain = F.when(schema == "BIGINT", "WHOLE").when(schema.isin("STRING", "BOOLEAN"), schema).when(schema == "ARRAY<BIGINT>", "ARRAY<WHOLE>")  # spared the patterns
    return plain.when(~schema.isin("VOID", "ARRAY<VOID>"), general)
