"""Standard values against expected texts, one row per rule."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard

NBSP = " "


def outputs(spark, function, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").repartition(2)
    got = rows.select("i", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(got)]


#: Ten digits and what becomes of them, under every combination of brackets and separators.
TEN = [(n, f"+1{n}") for n in ("3095551234", "8085550000", "9999999999")]
LAYOUTS = [(lead, gap, tail) for lead in ("", "(", " ") for gap in ("", "/", " - ", ")") for tail in ("", " ", "x")]

CASES = {
    "phone": [
        *[(f"{lead}{x[0][:3]}{gap}{x[0][3:6]}{gap}{x[0][6:]}{tail}", x[1]) for x in TEN for lead, gap, tail in LAYOUTS],
        *[(f"{lead}{n}", f"+{n}") for n in ("13095551234", "18085550000") for lead in ("", "+", "tel ", "\t")],
        *[(sep.join(n), n) for n in ("", "7", "4815162", "987654321", "29876543210", "447700900123") for sep in ("", " ", ".")],
        (None, ""),
    ],
    "state": [
        *[(s, "OR") for s in ("Oregon", "Ore.", "or", "Salem, OR", "Salem, Oregon", "Ore .", " OREGON\t")],
        ("Atlantis", "ATLANTIS"),
        (".", ""),
        (None, ""),
        ("  ", ""),
        ("Washington, D.C.", "WASHINGTON, D.C"),
        ("Salem, OR 97301", "SALEM, OR 97301"),
        ("constructor", "CONSTRUCTOR"),
        ("New\n  Mexico", "NM"),
        ("Calif.", "CA"),
        (f"{NBSP}Tex.{NBSP}", "TX"),
        ("a, b, Wash", "WA"),
        ("District of Columbia", "DC"),
    ],
    "email": [
        ("  Ann@X.COM ", "ann@x.com"),
        (f"{NBSP}Ann@x.com\t", "ann@x.com"),
        ("﻿ann@x.com", "ann@x.com"),
        (None, ""),
    ],
    "company": [(" Zenith \t\n Tools ", "Zenith Tools"), (f"a{NBSP} b", "a b"), (None, "")],
}


@pytest.mark.parametrize("field", CASES)
def test_standardisers(spark, field):
    given, expected = zip(*CASES[field])
    assert outputs(spark, standard.STANDARDISERS[field], given) == list(expected)


def plain_canonical(name):
    """Suffix words out, then all but letters and digits, one pass over the characters."""
    words, word = [], ""
    for c in name.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789_":
            word += c
        else:
            words, word = [*words, word, c], ""
    kept = "".join(" " if w in fixed.COMPANY_SUFFIXES else w for w in words)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in kept).split())


def test_canonical_company(spark):
    """Names put together from suffix words, other words and separators, accents and underscores among them."""
    rng = random.Random(5)
    parts = [*fixed.COMPANY_SUFFIXES, "Rügen", "nord", "OST", "x1", "é", "7"]
    joints = [" ", "-", ".", ", ", "_", "", "  & "]
    names = ["".join(rng.choice(parts).title() + rng.choice(joints) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    assert outputs(spark, standard.canonical_company, names) == [plain_canonical(n) for n in names]
    assert plain_canonical("Nord-Ost GmbH, Ltd.") == "nord ost gmbh" and plain_canonical("Co. Inc") == ""


def test_block_key(spark):
    cases = {
        ("Big Red Dog Co", "x@y.z"): "big red",
        ("Zenith, Inc.", ""): "zenith",
        ("", "a@x.org"): "x.org",
        ("", "a@"): "",
        ("", "a"): fixed.UNBLOCKED,
        ("", ""): fixed.UNBLOCKED,
        (None, None): fixed.UNBLOCKED,
        ("", "a@b@c"): "b",
        ("Labs", "A@Labs.Example"): "labs.example",
    }
    rows = [(i, c, e) for i, (c, e) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, c string, e string").repartition(2)
    got = df.select("i", standard.block_key(F.col("c"), F.col("e")).alias("k")).collect()
    assert [r.k for r in sorted(got)] == list(cases.values())


def test_state_spellings():
    codes = fixed.state_codes()
    assert len(codes) == 120
    assert len(set(codes.values())) == 51
