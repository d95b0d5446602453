"""Formula, adduct, mass and energy columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Monoisotopic masses in Da.
MASSES = {
    "H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Na": 22.9897692809, "Si": 27.9769265325,
    "P": 30.97376163, "S": 31.972071, "Cl": 34.96885268, "K": 38.96370668, "Br": 78.9183371, "I": 126.904473,
    "B": 11.0093054, "Se": 79.9165213, "Fe": 55.9349375, "Co": 58.933195, "As": 74.9215965,
}
#: Mass shift of each adduct in Da.
ADDUCT_SHIFTS = {
    "[M+H]+": 1.007276, "[M+Na]+": 22.989218, "[M+NH4]+": 18.033823, "[M+K]+": 38.963158, "[M-H]-": -1.007276, "[M+Cl]-": 34.969402,
    "[M]+": -0.000549, "[M+H3N+H]+": 18.033823, "[M-H2O+H]+": -17.003288, "[M+H-H2O]+": -17.003288, "[M-H4O2+H]+": -35.013853, "[M+H-2H2O]+": -35.013853,
    "[M-H2O-H]-": -19.017841, "[M-H-H2O]-": -19.017841, "[M-H-CO2]-": -44.997106,
}


#: An element and its count in a formula text.
ELEMENT = r"([A-Z][a-z]?)(\d*)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it: Spark repeats what a lambda names for each of its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def formula_counts(formula: Column) -> Column:
    """map<element, count> of a formula text; repeated elements are summed; null for a null text."""
    found = [F.regexp_extract_all(formula, F.lit(ELEMENT), F.lit(i)) for i in (1, 2)]
    pairs = F.zip_with(*found, lambda e, n: F.struct(e.alias("e"), F.coalesce(n.try_cast("int"), F.lit(1)).alias("n")))
    total = lambda p, e: F.aggregate(F.filter(p, lambda x: x["e"] == e), F.lit(0), lambda a, x: a + x["n"])
    names = lambda p: F.sort_array(F.array_distinct(F.transform(p, lambda x: x["e"])))
    return _once(pairs, lambda p: F.map_from_entries(F.transform(names(p), lambda e: F.struct(e, total(p, e)))))


def counts_of(formula: str) -> Column:
    """``formula_counts`` of one text, as a constant."""
    sums: dict[str, int] = {}
    for e, n in re.findall(ELEMENT, formula):
        sums[e] = sums.get(e, 0) + int(n or 1)
    return F.create_map(*[F.lit(x) for e in sorted(sums) for x in (e, sums[e])]).cast("map<string,int>")


def with_counts(df: DataFrame, out: str, formula: str) -> DataFrame:
    """``df`` with the column ``out``, ``formula_counts`` of another. It is generated, so that each row's text is read once for all later columns."""
    return df.select("*", F.explode(F.array(formula_counts(F.col(formula)))).alias(out))


def element(counts: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(name)), F.lit(0))


def formula_mass(counts: Column, masses: dict[str, float] = MASSES) -> Column:
    """Null if the formula holds an element without a mass."""
    known = F.forall(F.map_keys(counts), lambda e: e.isin(list(masses)))
    mass = F.lit(0.0)
    for e, m in masses.items():
        mass = mass + element(counts, e) * m
    return F.when(known, mass)


def formula_diff(a: Column, b: Column) -> Column:
    """map of a's counts minus b's, without zeros."""
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    pairs = F.transform(F.sort_array(names), lambda e: F.struct(e.alias("e"), (F.coalesce(F.try_element_at(a, e), F.lit(0)) - F.coalesce(F.try_element_at(b, e), F.lit(0))).alias("n")))
    return F.map_from_entries(F.filter(pairs, lambda x: x["n"] != 0))


def formula_text(counts: Column) -> Column:
    """C, then H, then the others by name; a count of 1 isn't written."""
    names = F.map_keys(counts)
    rest = F.array_sort(F.filter(names, lambda e: ~e.isin("C", "H")))
    order = F.concat(F.filter(F.array(F.lit("C"), F.lit("H")), lambda e: F.array_contains(names, e)), rest)
    return F.array_join(F.transform(order, lambda e: F.concat(e, F.when(F.element_at(counts, e) != 1, F.element_at(counts, e).cast("string")).otherwise(""))), "")


def family_label(counts: Column) -> Column:
    """halogen, sulfur_phosphorus, nitrogen, oxygen_rich (O over half of C), hydrocarbon, other; unassigned for null."""
    def has(*names: str) -> Column:
        return sum((element(counts, n) for n in names[1:]), element(counts, names[0])) > 0

    c, o = element(counts, "C"), element(counts, "O")
    return (
        F.when(counts.isNull(), "unassigned").when(has("F", "Cl", "Br", "I"), "halogen").when(has("S", "P"), "sulfur_phosphorus").when(has("N"), "nitrogen")
        .when(2 * o > c, "oxygen_rich").when((c > 0) & (o == 0), "hydrocarbon").otherwise("other")
    )


def has_valid_elements(counts: Column, allowed: list[str]) -> Column:
    return F.forall(F.map_keys(counts), lambda e: e.isin(allowed))


def polarity_of(adduct: Column) -> Column:
    """1 for a text ending in +, 0 for -, else null."""
    return F.when(adduct.endswith("+"), 1).when(adduct.endswith("-"), 0)


def adduct_of(polarity: Column, names: dict[int, str] | None = None) -> Column:
    names = names or {1: "[M+H]+", 0: "[M-H]-"}
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(polarity == k, v).otherwise(out)
    return out


def neutral_mass(mz: Column, adduct: Column, shifts: dict[str, float] = ADDUCT_SHIFTS) -> Column:
    """m/z minus the adduct's shift; null for an unknown adduct."""
    out = F.lit(None).cast("double")
    for name, shift in shifts.items():
        out = F.when(adduct == name, mz - shift).otherwise(out)
    return out


def nce_to_ev(nce: Column, precursor_mz: Column) -> Column:
    return nce * precursor_mz / 500.0


def ev_to_nce(ev: Column, precursor_mz: Column) -> Column:
    return ev * 500.0 / precursor_mz


def parse_collision(text: Column) -> Column:
    """The first number of texts such as "HCD 35 eV" or "20.5%"; null if there's none."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def bucket_label(value: Column, bins: list[tuple[float, float, str]]) -> Column:
    """The label of the first bin with low <= value < high; null in gaps."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(bins):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def block_type(header: Column) -> Column:
    """The first word of a header without its marks, in lower case."""
    return F.lower(F.regexp_extract(header, r"^[>#\s]*(\w+)", 1))
