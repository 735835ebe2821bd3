"""Licence notices and texts, by Dice coefficient over word bigrams.

Each line, each block between empty lines and the whole text is a unit. Notices inside longer
units, or with other line breaks, are found by windows: as many words as the template has,
from every eighth of that number on. Units, windows and templates are normalised alike: small
letters, with everything but letters and digits as spaces. The Dice coefficient of their sets
of word bigrams decides. Of the licences that a unit, or the windows around one phrase,
resemble, the best stands, of equal ones the first by name: a notice of one version is
not also one of the other.

Pruning loses nothing. At a coefficient of at least t, a unit has between
t / (2 - t) and (2 - t) / t times the template's bigrams, and at least t / (2 - t)
of those of the template itself. So of any more than 1 - t / (2 - t) of them it has
one: texts that hold none of these phrases (the longest ones of each template) are
passed over, other units are compared only with templates in their range of sizes, and
windows are taken only around phrases.

Everything is a Spark SQL expression over one row: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import running, text_of, then

DICE = 0.8
#: A window starts at every so many parts of a template's words.
STEPS = 8

# Names and wordings of licence notices and of licence texts.
_GNU = (
    "is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free "
    "Software Foundation{2} either version {3} of the License, or (at your option) any later version."
)
_GNU_WARRANTY = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL, _LGPL, _AGPL = ("General Public License", "Lesser General Public License", "Affero General Public License")
TEMPLATES = (
    ("AGPL-3.0", "This program " + _GNU.format(":", _AGPL, ",", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
        "whom the Software is furnished to do so, all subject to the following:",
    ),
    ("BSD-2-Clause", _BSD_TERMS + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", " ".join((_BSD_TERMS, _BSD_THIRD, _BSD_WARRANTY))),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program " + _GNU.format(";", _GPL, ";", "2")),
    ("GPL-2.0", f"This program {_GNU.format(';', _GPL, ';', '2')} This program {_GNU_WARRANTY.format(_GPL)}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program " + _GNU.format(":", _GPL, ",", "3")),
    ("GPL-3.0", f"This program {_GNU.format(':', _GPL, ',', '3')} This program {_GNU_WARRANTY.format(_GPL)}"),
    ("ISC", _ISC_GRANT),
    ("ISC", _ISC_GRANT + " " + _ISC_WARRANTY),
    ("LGPL-2.1", "This library " + _GNU.format(";", _LGPL, ";", "2.1")),
    ("LGPL-3.0", "This library " + _GNU.format(":", _LGPL, ",", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + " " + _MIT_WARRANTY),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:",
    ),
)


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _words(template: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", template.lower())


def normalised(text: Column) -> Column:
    """Small letters, and one space for each run of anything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def required(bigrams: list[str], dice: float) -> list[str]:
    """Bigrams of a template of which a unit as similar as ``dice`` has one at least."""
    enough = int(len(bigrams) * (1 - dice / (2 - dice)) + 1e-9) + 1
    return sorted(bigrams, key=lambda b: (-len(b), b))[:enough]


def bigrams_of(text: Column) -> Column:
    """The set of word bigrams of a normalised text."""
    words = F.array(F.split(text, " "))
    pairs = F.transform(
        words,
        lambda w: F.zip_with(
            F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)
        ),
    )
    return F.array_distinct(pairs[0])


def _best(found: Column, dice: float) -> Column:
    """Of an array of (license, dice, ...) those as similar as ``dice``, and of these the best one, as an array."""
    able = F.filter(found, lambda m: m["dice"] >= dice)
    most = lambda x: F.array_max(F.transform(x, lambda m: m["dice"]))
    return then(able, lambda x: F.slice(F.array_sort(F.filter(x, lambda m: m["dice"] == most(x))), 1, 1))


def matches(text: Column, dice: float = DICE, templates=TEMPLATES) -> Column:
    """Array of (license, dice, unit, text): the best licence of every unit, and of the windows around every phrase."""
    known = [(name, len(_words(wording)), _bigrams(_words(wording))) for name, wording in templates]
    phrases = sorted({p for _, _, b in known for p in required(b, dice)})
    ratio = dice / (2 - dice)
    least, most = min(len(b) for _, _, b in known) * ratio, max(len(b) for _, _, b in known) / ratio
    nothing = F.expr("cast(array() as array<struct<license:string,dice:double,unit:string,text:string>>)")

    def units(name: str, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(name).alias("unit"), normalised(p).alias("text")))

    every = F.concat(
        units("line", F.split(text, "\n", -1)),
        units("block", F.split(text, r"\n[ \t\r]*\n", -1)),
        units("text", F.array(text)),
    )
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    around = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    hit = " (?=(" + _any(phrases) + ") )"
    sized = F.filter(every, lambda u: (spaces(u["text"]) >= least - 1e-9) & F.regexp_like(around(u["text"]), F.lit(hit)))
    with_bigrams = F.transform(
        sized, lambda u: F.struct(u["unit"].alias("unit"), u["text"].alias("text"), bigrams_of(u["text"]).alias("b"))
    )

    def match(name: Column, value: Column, unit: Column, text: Column) -> Column:
        return F.struct(name.alias("license"), value.alias("dice"), unit.alias("unit"), text.alias("text"))

    def compared(u: Column) -> Column:
        n = F.size(u["b"])
        found = []
        for name, _, b in known:
            inside = (n >= len(b) * ratio - 1e-9) & (n <= len(b) / ratio + 1e-9)
            common = F.size(F.array_intersect(u["b"], F.array(*[F.lit(x) for x in b])))
            value = F.when(inside, 2 * common / (n + len(b))).otherwise(0.0)
            found.append(match(F.lit(name), value, u["unit"], u["text"]))
        return _best(F.array(*found), dice)

    # of each template what windows need, and of each phrase the templates that hold it
    table = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.lit(n).alias("n"), F.lit(max(1, n // STEPS)).alias("step"),
            F.array(*[F.lit(x) for x in b]).alias("b"),
        )
        for name, n, b in known
    ])
    holding = F.array(*[F.array(*[F.lit(k) for k, (_, _, b) in enumerate(known) if p in b]) for p in phrases])

    def windows(x: Column) -> Column:
        words = x["words"]

        def of(h: Column) -> Column:
            def best(t: Column) -> Column:
                # windows that hold both words of the phrase
                low = F.greatest(F.ceil((h["at"] + 2 - t["n"]) / t["step"]).cast("int"), F.lit(0))
                starts = F.sequence(low, F.floor(h["at"] / t["step"]).cast("int"))

                def measured(s: Column) -> Column:
                    part = F.array_join(F.slice(words, s * t["step"] + 1, t["n"]), " ")
                    return then(
                        F.struct(bigrams_of(part).alias("b"), part.alias("text")),
                        lambda p: match(
                            t["license"],
                            2 * F.size(F.array_intersect(p["b"], t["b"])) / (F.size(p["b"]) + F.size(t["b"])),
                            F.lit("window"), p["text"],
                        ),
                    )

                return F.when(low <= F.floor(h["at"] / t["step"]), F.transform(starts, measured))

            templates_ = F.transform(F.get(holding, F.array_position(F.array(*map(F.lit, phrases)), h["phrase"]).cast("int") - 1), lambda k: F.get(x["table"], k))
            return _best(F.flatten(F.filter(F.transform(templates_, best), lambda a: a.isNotNull())), dice)

        return F.array_distinct(F.flatten(F.transform(x["hits"], of)))

    def with_hits(whole: Column) -> Column:
        """Places, in words, of the phrases in a text between spaces."""
        found = F.regexp_extract_all(whole, F.lit(hit), F.lit(1))
        before = F.slice(F.split(whole, hit, -1), 1, F.size(found))
        counts = running(F.transform(before, lambda b: spaces(b) + 1))
        hits = F.transform(
            F.arrays_zip(found.alias("phrase"), counts.alias("at"), before.alias("before")),
            lambda h: F.struct((h["at"] + spaces(h["before"])).cast("int").alias("at"), h["phrase"].alias("phrase")),
        )
        return F.struct(F.split(F.trim(whole), " ").alias("words"), hits.alias("hits"), table.alias("table"))

    small = F.filter(with_bigrams, lambda u: F.size(u["b"]) <= most + 1e-9)
    whole = around(normalised(text))
    return F.when(
        F.regexp_like(whole, F.lit(hit)),
        F.concat(F.flatten(F.transform(small, compared)), then(then(whole, with_hits), windows)),
    ).otherwise(nothing)


def _any(phrases: list[str]) -> str:
    """A pattern for any of the phrases that goes through them letter by letter."""
    groups: dict[str, list[str]] = {}
    for p in phrases:
        groups.setdefault(p[:1], []).append(p[1:])
    ends = "" in groups
    parts = [letter + _any(rest) for letter, rest in groups.items() if letter]
    if not parts:
        return ""
    inner = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
    return inner + "?" * ends


def with_licenses(docs: DataFrame, text: str = "text", column: str = "licenses", dice: float = DICE) -> DataFrame:
    """``docs`` and ``column``, the matches of every row; none for a null or empty text.

    A match is (license, dice, unit, text), see ``matches``. Repeated rows each have their own.
    No rows: no rows. Other columns come back as they are; ``column`` must be new.
    """
    return docs.withColumn(column, matches(text_of(text), dice))


def summary(found: Column) -> dict[str, Column]:
    """Of the matches: the names in order, the best one (the first in order, of equals), and counts."""
    best = F.array_max(F.transform(found, lambda m: m["dice"]))
    first = F.array_min(F.transform(F.filter(found, lambda m: m["dice"] == best), lambda m: m["license"]))
    lines = F.size(F.array_distinct(F.transform(F.filter(found, lambda m: m["unit"] == "line"), lambda m: m["text"])))
    return {
        "licenses": F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["license"]))), ","),
        "best_license": first,
        "best_dice": best,
        "n_lines": lines.cast("bigint"),
    }
