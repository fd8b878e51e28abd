"""Column functions: names, times, units and policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Life classes: (class, from, to), the upper end exclusive (fixed values).
LIFE_CLASSES = ((1, 0, 300), (2, 300, 1000), (3, 1000, 2000), (4, 2000, 100_000_000))

#: Dataset ids by the prefix of a cell's name (fixed values).
DATASET_IDS = {
    "CALCE": 0, "HNEI": 1, "HUST": 2, "MATR": 3, "RWTH": 4, "SNL": 5, "MICH": 6, "MICH_EXP": 7, "Tongji1": 8, "Stanford": 9,
    "ISU-ILCC": 11, "XJTU": 12, "ZN-coin": 13, "UL-PUR": 14, "Tongji2": 15, "Tongji3": 16, "CALB": 17, "ZN42": 22, "ZN2024": 23,
    "CALB42": 24, "CALB2024": 25, "NA-ion": 27, "NA-ion42": 28, "NA-ion2024": 29,
}


def name_prefix(name: Column) -> Column:
    """First token of a cell's name; for CALB the first two."""
    parts = F.split(name, "_")
    return F.when(parts[0] == "CALB", F.concat_ws("_", parts[0], F.get(parts, 1))).otherwise(parts[0])


def name_rates(name: Column) -> Column:
    """(charge, discharge) rates from the last token but one, less its closing letter."""
    token = F.try_element_at(F.split(name, "_"), F.lit(-2))
    rates = F.split(F.substring(token, F.lit(1), F.length(token) - 1), "-")
    return F.struct(F.get(rates, 0).try_cast("double").alias("charge"), F.get(rates, 1).try_cast("double").alias("discharge"))


def cathode(name: Column) -> Column:
    return F.get(F.split(name, "_"), 2)


def chemistry_flag(name: Column) -> Column:
    """0 for iron phosphate cells (MATR, HUST or LFP in the name), else 1."""
    return F.when(name.startswith("MATR") | name.startswith("HUST") | name.contains("LFP"), 0).otherwise(1)


def hms_to_seconds(text: Column) -> Column:
    """``H:M:S`` to seconds, with any date before a blank dropped; hours may pass 24."""
    clock = F.split(F.element_at(F.split(F.trim(text), " "), -1), ":")
    part = lambda i: F.get(clock, i).try_cast("double")
    return part(0) * 3600 + part(1) * 60 + part(2)


def timestamp_to_seconds(text: Column, whole: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to epoch seconds; a number passes through; else null."""
    at = F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]"))) / 1e6
    at = F.floor(at).cast("double") if whole else at
    return F.coalesce(at, text.try_cast("double"))


def to_number(text: Column, dash_is_zero: bool = False) -> Column:
    """A finite double, or null."""
    value = F.when(F.trim(text) == "-", 0.0).otherwise(text.try_cast("double")) if dash_is_zero else text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def soc_span(low: Column, high: Column, absolute: bool = False) -> Column:
    """high - low, with 1 in place of 0; ``absolute``: its size, with 1 where it is tiny or not finite."""
    span = high - low
    if absolute:
        span = F.abs(span)
        return F.when(span.isNull() | F.isnan(span) | (span == float("inf")) | (span <= 1e-12), 1.0).otherwise(span)
    return F.when(span == 0, 1.0).otherwise(span)


def natural_key(text: Column) -> Column:
    """Sort key that orders numbers inside names by value: b2 before b10."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "\x00")


def nominal_capacity(name: Column, stored: Column) -> Column:
    """The overrides by name, else the stored value; not finite or null: 0."""
    value = stored.try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return (
        F.when(name.startswith("RWTH"), 1.85)
        .when(name.startswith("SNL_18650_NCA_25C_20-80"), 3.2)
        .when(fine, value)
        .otherwise(0.0)
    )


#: Nominal capacities that follow from names (fixed values): (prefix, pattern of the name, Ah), the first that fits holds.
NAMED_CAPACITIES = [
    ("SNL", "NMC.*15C|15C.*NMC", 3 * 0.9),
    ("SNL", "NMC", 3.0),
    ("SNL", "NCA.*20-80|20-80.*NCA", 3.2),
    ("SNL", "NCA.*15C|15C.*NCA", 3.2 * 0.9),
    ("SNL", "NCA", 3.2),
    ("SNL", "", 1.1),
    ("UL-PUR", r"2\.5-96\.5", 3.4 * 0.94 * 3.4),
    ("UL-PUR", "", 3.4),
    ("Farasis", "Farasis_PA|_0(?:0[1-9]|1[0-9])_single_parquet", 73.0),
    ("Farasis", "Farasis_P[BC]|_(?:0[2-9][0-9]|10[0-9]|11[0-2])_single_parquet", 76.0),
    ("Farasis", "Farasis_PD|_(?:11[3-9]|12[0-3])_single_parquet", 84.0),
    ("Farasis", "", 0.0),
]


def named_capacity(name: Column) -> Column:
    """The nominal capacity that a cell's name implies, null where it implies none."""
    out = F.lit(None).cast("double")
    for prefix, pattern, value in reversed(NAMED_CAPACITIES):
        out = F.when(name.startswith(prefix) & name.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def life_class(eol: Column) -> Column:
    out = F.lit(None).cast("int")
    for label, low, high in LIFE_CLASSES:
        out = F.when((eol >= low) & (eol < high), label).otherwise(out)
    return out


def charge_policy(policy: Column) -> Column:
    """Charge stages (rate, start_soc, end_soc) of a policy such as ``5.4C(80%)-5.4C``.

    Stages with ``new`` in them are dropped. Two stages give the first up to its state of
    charge (in the policy's own unit, %) and the second to the end; more of them share
    the range in steps of 0.2.
    """
    stages = F.filter(F.split(policy, "-"), lambda x: ~x.contains("new"))
    number = lambda x: F.regexp_replace(x, "C$", "").try_cast("double")
    stage = lambda rate, start, end: F.struct(rate.alias("rate"), start.alias("start_soc"), end.alias("end_soc"))
    first = F.get(stages, 0)
    top = F.regexp_extract(first, r"C\((.*?)%\)", 1).try_cast("double")
    two = F.array(
        stage(F.regexp_extract(first, r"^(.*?)C\(", 1).try_cast("double"), F.lit(0.0), top),
        stage(number(F.get(stages, 1)), top, F.lit(1.0)),
    )
    many = F.transform(stages, lambda x, i: stage(x.try_cast("double"), i * 0.2, (i + 1) * 0.2))
    return F.when(F.size(stages) == 2, two).otherwise(many)
