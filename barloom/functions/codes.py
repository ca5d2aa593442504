"""Instrument codes: normalisation, board limits, listed-fund prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import _c, lit

# fixed values: exchange suffixes, listed-fund prefixes
EXCHANGE_SUFFIXES = ("sh", "ss", "sz", "bj")
LISTED_FUND_PREFIXES = ("15", "16", "50", "51", "52", "53", "56", "58")


def digits_only(x) -> Column:
    return F.regexp_replace(_c(x), "[^0-9]", "")


def normalize_code(x) -> Column:
    """Any spelling to exchange prefix + six digits, or '' when there are not six digits."""
    raw = F.regexp_replace(F.lower(F.trim(_c(x))), "_", "")
    head = F.substring_index(raw, ".", 1)
    tail = F.regexp_extract(raw, r"\.(.*)$", 1)
    code = (
        F.when(F.instr(raw, ".") == 0, raw)
        .when(tail.isin(*EXCHANGE_SUFFIXES), F.concat(tail, head))
        .otherwise(head)
    )
    numeric = digits_only(code)
    prefix = F.substring(code, 1, 2)
    lead = F.substring(numeric, 1, 1)
    return (
        F.when(F.length(numeric) != 6, F.lit(""))
        .when(prefix.isin("sh", "sz", "bj"), F.concat(prefix, numeric))
        .when(lead.isin("4", "8", "9"), F.concat(F.lit("bj"), numeric))
        .when(lead.isin("5", "6"), F.concat(F.lit("sh"), numeric))
        .otherwise(F.concat(F.lit("sz"), numeric))
    )


def normalize_flow_code(x) -> Column:
    """The older rule used by flow tables: strips a ' - name' tail and never blanks the code."""
    raw = F.lower(F.trim(_c(x)))
    code = F.substring_index(raw, " - ", 1)
    dotted = F.size(F.split(code, r"\.")) == 2
    base = F.substring(code, -6, 6)
    lead = F.substring(base, 1, 1)
    return (
        F.when(raw == "", F.lit(""))
        .when(dotted, F.concat(F.substring_index(code, ".", -1), F.substring_index(code, ".", 1)))
        .when(F.substring(code, 1, 2).isin("sh", "sz", "bj"), code)
        .when(F.length(code) < 6, code)
        .when(lead == "6", F.concat(F.lit("sh"), base))
        .when(lead.isin("0", "3"), F.concat(F.lit("sz"), base))
        .when(lead.isin("8", "9"), F.concat(F.lit("bj"), base))
        .otherwise(code)
    )


def code_variants(x) -> Column:
    """All spellings of one code, as a sorted distinct array."""
    code = F.trim(_c(x))
    low = F.lower(code)
    prefix = F.substring(low, 1, 2)
    has = prefix.isin("sh", "sz", "bj")
    bare = F.when(has, F.substring(low, 3, 100)).otherwise(low)
    dotted = F.when(has, F.concat(bare, F.lit("."), F.upper(prefix)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(code, low, F.upper(code), bare, dotted))))


def _bare(x) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(x))), "^(sh)?(sz)?(bj)?", "")


def price_limit_rate(code, name) -> Column:
    """Daily price limit by board; special-treatment names come first."""
    bare = _bare(code)
    return (
        F.when(F.contains(F.upper(_c(name)), F.lit("ST")), lit(0.05))
        .when(F.substring(bare, 1, 3).isin("688", "300", "301"), lit(0.20))
        .when(F.substring(bare, 1, 1).isin("4", "8") | (F.substring(bare, 1, 2) == "92"), lit(0.30))
        .otherwise(lit(0.10))
    )


def pays_stamp_duty(code) -> Column:
    return ~F.substring(_bare(code), 1, 1).isin("1", "5")


def is_listed_fund(code) -> Column:
    return F.substring(digits_only(code), 1, 2).isin(*LISTED_FUND_PREFIXES)
