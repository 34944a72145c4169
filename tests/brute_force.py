"""The unification rules once more, in plain loops over small lists of records."""

import re
from collections import defaultdict

from kinfold.functions import fixed_values as fixed

FIELDS = ("company", "contactName", "email", "phone", "state")
PRIORITY = {"B": 1, "A": 2, "C": 3}
SUFFIX = fixed.COMPANY_SUFFIXES


def canonical(name):
    words = re.findall(r"[a-z0-9_]+|[^a-z0-9_]", name.lower())
    kept = "".join(" " if w in SUFFIX else w for w in words)
    return " ".join(re.findall("[a-z0-9]+", kept))


def good_phone(p):
    return bool(re.fullmatch(r"\+1[0-9]{10}", p))


def link_values(r):
    if r["email"]:
        yield "email", r["email"]
    if good_phone(r["phone"]):
        yield "phone", r["phone"]
    if r["contactName"]:
        yield "contact", r["contactName"].lower()


def clusters(records):
    """Record id -> id of the first record (in load order) that it is connected to."""
    order = sorted(records, key=lambda r: (r["source"], r["ordinal"]))
    label = {r["id"]: i for i, r in enumerate(order)}
    shared = defaultdict(list)
    for r in order:
        for value in link_values(r):
            shared[r["block_key"], *value].append(r["id"])
    changed = True
    while changed:
        changed = False
        for ids in shared.values():
            low = min(label[i] for i in ids)
            for i in ids:
                if label[i] != low:
                    label[i], changed = low, True
    return {i: order[at]["id"] for i, at in label.items()}


def form(field, value):
    if field == "company":
        return canonical(value)
    return value.lower() if field == "contactName" else value


def rank(field, r):
    value = r[field]
    full, length = 0, 0
    if field == "company":
        full = len(canonical(value).split())
    elif field == "contactName":
        full = sum(sum(c.isalpha() for c in word) >= 2 for word in value.split(" "))
        length = len(value)
    elif field == "email":
        full = bool(re.fullmatch(r"[^@ ]+@[^@ ]+\.[^@ ]+", value))
    elif field == "phone":
        full = good_phone(value)
    else:
        full = bool(re.fullmatch("[A-Z]{2}", value))
    return (value == "", -full, -length, PRIORITY[r["source"]], r["ordinal"])


def merge(records):
    """Entity id -> merged values, provenance, confidence, reasoning and members."""
    label = clusters(records)
    groups = defaultdict(list)
    for r in records:
        groups[label[r["id"]]].append(r)
    out = {}
    for entity, members in groups.items():
        winner = {f: min(members, key=lambda r: rank(f, r)) for f in FIELDS}
        shares, conflicts = 0.0, []
        for f in FIELDS:
            filled = [form(f, r[f]) for r in members if r[f]]
            share = 1.0
            if filled:
                share = filled.count(form(f, winner[f][f])) / len(filled)
            shares += share
            if len(set(filled)) > 1:
                conflicts.append(f)
        common = []
        for kind in ("email", "phone", "contact"):
            values = [v for r in members for k, v in link_values(r) if k == kind]
            if len(values) > len(set(values)):
                common.append(kind)
        if len(members) == 1:
            confidence, reasoning = 1.0, f"Single record from source {members[0]['source']}"
        else:
            confidence = int((0.5 + 0.1 * shares) * 10000 + 0.5) / 10000
            reasoning = (
                f"{len(members)} records share {', '.join(common)};"
                f" conflicting: {', '.join(conflicts) or 'none'}"
            )
        out[entity] = {
            **{f: winner[f][f] for f in FIELDS},
            "provenance": [(f, winner[f]["source"], winner[f][f]) for f in FIELDS],
            "confidence": confidence,
            "reasoning": reasoning,
            "members": sorted(r["id"] for r in members),
        }
    return out
