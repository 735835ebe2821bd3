from __future__ import annotations

import re

import pytest

from brindle.llm import licenses
from brindle.llm.queries import ORACLE_SQL, op6_license_dice
from tests.llm.sql import same_as_sql


def slow_words(x):
    return re.findall(r"[^\W_]+", x.lower())


def pairs(w):
    return set(zip(w, w[1:]))


KNOWN = [(name, slow_words(wording)) for name, wording in licenses.TEMPLATES]
PHRASES = {
    p for _, w in KNOWN
    for p in sorted(pairs(w), key=lambda p: (-len(" ".join(p)), " ".join(p)))[: int(len(pairs(w)) / 3 + 1e-9) + 1]
}


def slow(text, dice=0.8):
    """(license, dice, unit, words) of every unit, and of the windows around every phrase."""
    def best(found):
        able = sorted((-score, name, words) for name, score, words in found if score >= dice)
        return [(able[0][1], -able[0][0], able[0][2])] if able else []

    alike = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
    units = [("line", u) for u in text.split("\n")] + [("block", u) for u in re.split(r"\n[ \t\r]*\n", text)]
    found = []
    for kind, unit in [*units, ("text", text)]:
        w = slow_words(unit)
        found += [(kind, *m) for m in best([(n, alike(pairs(w), pairs(t)), " ".join(w)) for n, t in KNOWN])]
    w = slow_words(text)
    windows = set()
    for i, p in enumerate(zip(w, w[1:])):
        if p in PHRASES:
            around = []
            for name, t in KNOWN:
                if p in pairs(t):
                    step = max(1, len(t) // 8)
                    for s in range(0, i + 1, step):
                        if s + len(t) >= i + 2:
                            part = w[s : s + len(t)]
                            around.append((name, alike(pairs(part), pairs(t)), " ".join(part)))
            windows |= {("window", n, x) for n, x, _ in best(around)}
    return sorted(found), windows


MIT = licenses._MIT_GRANT
FULL = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name, _ in licenses.TEMPLATES}
ODD = [
    "", None, "\n \n", "a", "Released under the MIT License.", "released, UNDER the\nmit license", "é Licensed under CC BY-NC 4.0!",
    f"Some words here.\n\n{MIT[:200]}\n{MIT[200:]}\n\nAnd more words.", MIT.upper(), MIT.replace("Software", "Work"), MIT[:300],
    "This work is licensed under the GNU General Public License, version 3.", "x " * 50_000, "under the MIT License " * 2000,
    "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0.",
    "we say that it is Released under the MIT License. And then some more is said in this line.",
    "_under_score released under mit_license the", "redistribution and " * 40,
]


@pytest.mark.parametrize("name", sorted(FULL))
@pytest.mark.parametrize("form", ["plain", "reflowed", "commented", "within"])
def test_full_texts_are_found_however_they_are_laid_out(spark, name, form):
    words = FULL[name].split()
    lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
    other = "some other words of a page that has nothing to do with it and goes on "
    LAID[form, name] = {
        "plain": FULL[name], "reflowed": "\n".join(lines), "commented": "\n".join("# " + x for x in lines) + "\nimport os\n" * 3,
        "within": other * 5 + FULL[name] + " " + other * 4,
    }[form]
    if len(LAID) == 4 * len(FULL):
        df = spark.createDataFrame([(*k, t) for k, t in LAID.items()], "form string, name string, text string")
        for r in licenses.with_licenses(df).collect():
            assert {m.license for m in r.licenses} == {r.name}, (r.form, r.name, r.licenses)


LAID: dict = {}


def test_notices_of_one_version_are_not_of_another(spark):
    texts = {n: "This program " + licenses._GNU.format(*x) for n, x in {
        "GPL-2.0": (";", licenses._GPL, ";", "2"), "GPL-3.0": (":", licenses._GPL, ",", "3"), "AGPL-3.0": (":", licenses._AGPL, ",", "3")
    }.items()}
    df = spark.createDataFrame([(n, f"// {t}\nint x;") for n, t in texts.items()], "name string, text string")
    assert all({m.license for m in r.licenses} == {r.name} for r in licenses.with_licenses(df).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = same_as_sql(op6_license_dice(spark, sf), ORACLE_SQL["op6_license_dice"], sf)
    assert any(r[1] for r in rows) or sf.endswith("0.001")


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(None, MIT, 1)] * 2, "doc_id int, text string, dice int")
    for r in licenses.with_licenses(df).collect():
        units, windows = slow(r.text or "")
        got = sorted((m.unit, m.license, m.dice, m.text) for m in r.licenses if m.unit != "window")
        assert got == units, (r.text or "")[:80]
        assert {("window", m.license, m.dice) for m in r.licenses if m.unit == "window"} == windows, (r.text or "")[:80]
    assert licenses.with_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("dice", [0.6, 0.8, 0.95])
def test_required_phrases_leave_none_out(dice):
    for _, wording in licenses.TEMPLATES:
        b = licenses._bigrams(licenses._words(wording))
        rest = set(b) - set(licenses.required(b, dice))
        # a unit of all other bigrams is still less similar
        assert 2 * len(rest) / (len(rest) + len(b)) < dice
