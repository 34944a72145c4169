"""Value standardisation as column expressions (no Python runs per row).

Blank stands for absent everywhere: every function maps null to ``""``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed

# Whitespace beyond what SQL trim knows: control whitespace, no-break and other Unicode spaces, BOM.
SPACES = "".join(
    map(
        chr,
        [
            *(0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B)),
            *(0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF),
        ],
    )
)

# \b would treat accented letters as word characters, hence explicit ASCII look-arounds.
SUFFIX_PATTERN = (
    r"(?<![A-Za-z0-9_])(?:" + "|".join(fixed.COMPANY_SUFFIXES) + r")(?![A-Za-z0-9_])"
)


def filled(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def trim_space(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def collapse_space(value: Column) -> Column:
    return F.regexp_replace(F.translate(value, SPACES, " " * len(SPACES)), " {2,}", " ")


def text(value: Column) -> Column:
    """Free text with whitespace runs collapsed and the ends trimmed."""
    return F.trim(collapse_space(filled(value)))


def email(value: Column) -> Column:
    return F.lower(trim_space(filled(value)))


def phone(value: Column) -> Column:
    """E.164 for plausible US numbers, otherwise the bare digits."""
    digits = F.regexp_replace(filled(value), "[^0-9]", "")
    return (
        F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        .otherwise(digits)
    )


def state_lookup() -> Column:
    """All spellings as one map, folded to a literal by the optimizer."""
    pairs = ",".join(f"{spelling}:{code}" for spelling, code in fixed.state_codes().items())
    return F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":"))


def state(value: Column) -> Column:
    """USPS code of a state or of a "City, ST" location; unknown values upper-cased."""
    no_dots = F.rtrim(trim_space(filled(value)), F.lit("."))
    cleaned = F.lower(collapse_space(no_dots))
    last_part = trim_space(F.substring_index(cleaned, ",", -1))
    codes = state_lookup()
    return F.coalesce(codes[cleaned], codes[last_part], F.upper(cleaned))


def is_state_code(value: Column) -> Column:
    return value.isin(*fixed.STATE_SPELLINGS)


def canonical_company(value: Column) -> Column:
    """Lower-case significant words of a company name, single-spaced.

    Suffix words go before punctuation, so that a dotted or hyphenated word is still seen whole.
    """
    significant = F.regexp_replace(F.lower(filled(value)), SUFFIX_PATTERN, " ")
    return F.trim(F.regexp_replace(significant, "[^a-z0-9]+", " "))


def block_key(company: Column, email_value: Column) -> Column:
    """First two significant company words, else the email domain, else a shared bucket."""
    return block_key_of(canonical_company(company), email(email_value))


def block_key_of(canonical: Column, standard_email: Column) -> Column:
    """The block key from values that are standardised already."""
    front = F.substring_index(canonical, " ", 2)
    domain = F.get(F.split(standard_email, "@"), F.lit(1))
    return F.coalesce(F.nullif(front, F.lit("")), domain, F.lit(fixed.UNBLOCKED))


def fold_ascii(value: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_text(fragment: Column) -> Column:
    """Text of a markup fragment: tags out, references decoded, whitespace collapsed."""
    untagged = F.regexp_replace(fragment, fixed.TAG_PATTERN, "")
    decoded = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])),
        fixed.CHARACTER_REFERENCES,
        untagged,
    )
    return F.trim(collapse_space(decoded))


STANDARDISERS = {"company": text, "contactName": text, "email": email, "phone": phone, "state": state}
