"""Column expressions that read the texts of a sale export."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from valora.functions.missing import tagged

BAND = r"^(low|middle|high) floor"
TOTAL = r"total (\d+) floors"
REMARK_FIRST, REMARK_THEN = r"of (\d+) floors", r"level \d+/(\d+)"
LADDER = r"(\d+) lifts (\d+) households"


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern isn't found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def floor(raw: Column) -> tuple[Column, Column, Column]:
    """Band, total floors and status."""
    band, total = extracted(raw, BAND), extracted(raw, TOTAL).cast("int")
    _, status = tagged(raw, F.when(total.isNotNull(), band))
    return F.when(status == "PARSED", band), F.when(status == "PARSED", total), status


def floors_from_remark(remark: Column) -> Column:
    found = F.coalesce(extracted(remark, REMARK_FIRST), extracted(remark, REMARK_THEN)).cast("int")
    return F.when(found.between(1, 60), found)


def floor_bucket(total: Column) -> Column:
    return F.when(total <= 6, "low-rise").when(total <= 18, "mid-rise").when(total.isNotNull(), "high-rise")


def elevator(raw: Column, total: Column) -> tuple[Column, Column]:
    """Tri-state value and its basis: disclosed beats inferred (more than seven floors), else unknown."""
    said = F.when(raw == "yes", True).when(raw == "no", False)
    guess = F.when(total > 7, True)
    basis = F.when(said.isNotNull(), "disclosed").when(guess.isNotNull(), "inferred").otherwise("unknown")
    return F.coalesce(said, guess), basis


def decoration(raw: Column) -> tuple[Column, Column]:
    return tagged(raw, F.when(F.lower(F.trim(raw)).isin("fine", "simple", "rough"), F.lower(F.trim(raw))))


def orientation(raw: Column) -> tuple[Column, Column]:
    text = F.lower(F.trim(raw))
    return tagged(raw, F.when(text.isin("s", "south"), "south").when(text == "north-south", "north-south").when(text.isin("n", "north"), "north"))


def year_built(raw: Column) -> tuple[Column, Column]:
    year = extracted(raw, r"^(\d{4})$").cast("int")
    return tagged(raw, F.when(year.between(1900, 2100), year))


def dated(raw: Column) -> tuple[Column, Column]:
    """Date and precision: a month alone is its first day, and never counts as a day."""
    by_day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    by_month = F.when(raw.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(raw, F.lit("-01")), "yyyy-MM-dd"))
    return F.coalesce(by_day, by_month), F.when(by_day.isNotNull(), "day").when(by_month.isNotNull(), "month").otherwise("unknown")


def unit_price(total: Column, area: Column) -> Column:
    return F.try_divide(total, area)


def normal_name(name: Column, district: Column) -> tuple[Column, Column]:
    """Comparable name, and whether its parenthesis names another district. Full-width signs are
    folded, blanks and dots dropped; the own district's parenthesis is dropped on this copy only."""
    folded = F.regexp_replace(F.translate(F.lower(F.trim(name)), "（）·・", "()··"), r"[\s·.]+", "")
    named = extracted(folded, r"\(([^()]*)\)$")
    own = named.isNull() | (named == F.regexp_replace(F.lower(district), r"\s+", ""))
    return F.when(own, F.regexp_replace(folded, r"\([^()]*\)$", "")).otherwise(folded), ~own


def lift_ratio(raw: Column) -> Column:
    return F.try_divide(extracted(raw, LADDER, 1).cast("double"), extracted(raw, LADDER, 2).cast("double"))


# What an attached field may say.
OWNERSHIPS, TAX_CLASSES, TENURES = ("sole", "shared"), ("over five years", "over two years", "under two years"), ("commodity", "public", "affordable")


def attached(raw: Column) -> dict[str, tuple[Column, Column]]:
    """Fields of an attached text such as 'area: Park; ownership: sole; tax: over two years; tenure: public', each with
    its status. What isn't said is MISSING, what can't be read a PARSE_FAILURE; neither is guessed."""
    out = {}
    for name, label, known in (("area_block", "area", None), ("ownership", "ownership", OWNERSHIPS), ("tax_class", "tax", TAX_CLASSES), ("tenure", "tenure", TENURES)):
        said = extracted(F.lower(raw) if known else raw, rf"(?:^|; ?){label}: ([^;]*)")
        out[name] = tagged(F.trim(said), F.when(F.trim(said).isin(*known), F.trim(said)) if known else F.nullif(F.trim(said), F.lit("")))
    return out


# Kinds of building.
BUILDINGS = ("tower", "slab", "slab and tower", "bungalow")


def building_type(raw: Column) -> tuple[Column, Column]:
    return tagged(raw, F.when(F.lower(F.trim(raw)).isin(*BUILDINGS), F.lower(F.trim(raw))))


def efficiency(net: Column, gross: Column) -> Column:
    """Share of the gross area that is usable; null where either is unknown or the gross area is the smaller one."""
    return F.when(gross >= net, F.try_divide(net, gross))


# Shapes of text that must not be published.
SENSITIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "national id": r"\b[0-9]{17}[0-9Xx]\b",
    "card": r"\b[0-9]{16}\b",
    "listing": r"\bLJ[0-9]{6,}\b",
    "user": r"\bUSER-[0-9A-Za-z]+\b",
    "token": r"\bsk-[0-9A-Za-z]{8,}\b",
    "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "key": r"\b[0-9a-f]{32,}\b",
}


def masked(text: Column) -> Column:
    for kind, pattern in SENSITIVE.items():
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return text
