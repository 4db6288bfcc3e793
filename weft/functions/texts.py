"""Text expressions: formats, formulas, labels and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(x: Column) -> Column:
    return F.get(F.split(F.trim(x), r"\s+"), 0)


def trimmed(x: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def without_prefix(x: Column) -> Column:
    return F.regexp_replace(x, r"^\d+_", "")


def natural_key(x: Column) -> Column:
    """The leading number, or infinity: orders 1_A, 2_C, 10_B."""
    return F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("double"), F.lit(float("inf")))


def shown(x: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit("N.A."))


def number(x: Column) -> Column:
    """The number in a text; NULL for N.A., NaN and other texts."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def threshold_name(x: Column) -> Column:
    return F.replace(x.cast("string"), F.lit("."), F.lit("_"))


def threshold_value(x: Column) -> Column:
    return F.replace(F.regexp_extract(x, r"(\d+_\d+)", 1), F.lit("_"), F.lit(".")).try_cast("double")


def field(text: Column, name: str) -> Column:
    """The line after an SDF tag."""
    return F.regexp_extract(text, rf"(?m)^>\s*<\Q{name}\E>[^\n]*\n([^\n]*)", 1)


def has_field(text: Column, name: str) -> Column:
    return text.rlike(rf"(?m)^>\s*<\Q{name}\E>")


def sdf_atoms(record: Column) -> Column:
    """The atom count of a record's fourth line; 0 where there is none."""
    body = F.regexp_replace(record, r"^\n", "")
    line = F.get(F.split(body, "\n"), 3)
    return F.coalesce(F.trim(F.substring(line, 1, 3)).try_cast("int"), F.lit(0))


def occurrences(text: Column, literal: str) -> Column:
    return F.size(F.split(text, rf"\Q{literal}\E")) - 1


def formula_counts(x: Column) -> Column:
    """"C12H4O" as {C: 12, H: 4, O: 1}; an element named twice is summed."""
    names, digits = (F.regexp_extract_all(x, F.lit(r"([A-Z][a-z]*)(\d*)"), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(names.alias("e"), digits.alias("n"))
    count = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + F.coalesce(p["n"].try_cast("int"), F.lit(1)))
    kinds = F.array_distinct(names)
    return F.map_from_arrays(kinds, F.transform(kinds, count))


def formula_text(counts: Column) -> Column:
    """The other way round, elements in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], e["value"].cast("string"))), "")


def symbol(label: Column, known: Column) -> Column:
    """The element of an atom label: its first two letters if they are one, else the first."""
    two, one = F.initcap(F.substring(label, 1, 2)), F.upper(F.substring(label, 1, 1))
    return F.when(F.array_contains(known, two), two).when(F.array_contains(known, one), one)


def counted_text(counts: Column) -> Column:
    """{Fe: 3, Mn: 1} as "Fe(3), Mn(1)"."""
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit("("), e["value"].cast("string"), F.lit(")"))), ", ")


def counted_map(text: Column) -> Column:
    names, numbers = (F.regexp_extract_all(text, F.lit(r"(\w+)\((\d+)\)"), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, F.transform(numbers, lambda n: n.cast("int")))


def component_map(text: Column) -> Column:
    """"01: [..]; 02: None" as a map of vectors, components without one left out."""
    names, lists = (F.regexp_extract_all(text, F.lit(r"([^:;\s]+):\s*(\[[^\]]*\])"), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, F.transform(lists, lambda x: F.from_json(x, "array<double>")))


def tuple_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"'([^']*)'"), F.lit(1))


def after_colon(text: Column) -> Column:
    return F.trim(F.get(F.split(text, ":", 2), 1))


def smiles_elements(text: Column) -> Column:
    """Distinct element symbols: those in brackets, and the organic ones outside."""
    inside = F.regexp_extract_all(text, F.lit(r"\[\d*([A-Z][a-z]?|[cnops])"), F.lit(1))
    outside = F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]]*\]", " "), F.lit(r"(Cl|Br|[BCNOPSFI]|[bcnops])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(inside, outside), lambda e: F.initcap(e))))


def ids(x: Column) -> Column:
    return F.upper(F.trim(x))
