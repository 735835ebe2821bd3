"""Secrets in texts: known forms, and strings that pass a battery of randomness tests.

Everything is a Spark SQL expression over one row, but for the thresholds of the
battery, which are a few numbers per class of lengths.

Known forms are found leftmost first and without overlap, each kind by itself, and
kept if long enough; see ``KINDS``. Spans count code points, end exclusive.

The battery looks at runs of ``RUN``, 16 characters and more, in what the known forms
leave: of a run that a known form covers in part, the rest is tested. A run's encoding is
the narrowest alphabet that holds it. Three tests say whether its symbols could be
drawn from that alphabet at random, each as a number of standard deviations:

- chi-squared uniformity of the symbol counts,
- runs of symbols in the lower and the upper half of the alphabet,
- serial correlation of neighbouring symbols.

A run beyond ``FIT`` in any of them is not random. For the others the same three tests,
each with the features of text for its null, give the p-values that are combined. They
are Chernoff's and Hoeffding's bounds, so they hold at every length:

- uniformity: symbols coincide, as chi-squared has it, as often as in text or more,
- runs: runs of small letters, of capitals, of digits and of signs are as long as in text or longer,
- serial correlation: vowels and other letters follow one another as often as in text or more.

Fisher's method combines them into one p-value. Benjamini and Hochberg's step-up rule at
``RATE`` then sets a threshold for each class of lengths (powers of two) over all
runs of the corpus, so that short runs, of which there are many, don't hide long ones.
The rule works on counts of p-values in bins of half a natural logarithm, of which
there are at most ``BINS`` per class, each taken at its upper edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fresh, running, text_of, then

# Kind, pattern, the group that is measured, its least length.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RANDOM = "random"
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
# Alphabets from narrow to wide, in order of their symbols.
_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _SMALL.upper() + "234567"),
    ("base36", _DIGITS + _SMALL),
    ("base62", _SMALL.upper() + _SMALL + _DIGITS),
    ("base64", _SMALL.upper() + _SMALL + _DIGITS + "+/"),
    ("base64url", _SMALL.upper() + _SMALL + _DIGITS + "-_"),
    ("base66", _SMALL.upper() + _SMALL + _DIGITS + "+/-_"),
)
#: Standard deviations from random that are still accepted.
FIT = 4.0
#: Of text: the share of equal pairs of symbols, of neighbours of different sorts, and of
#: neighbouring letters of which one is a vowel and one is not (0.57 to 0.73 in the four languages tried).
EQUAL, TURNS, SWAPS = 0.065, 0.25, 0.55
RATE = 0.01
BINS = 121
MASK = "[SECRET]"


def _found(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, value) of the matches whose group has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    # what follows the last match has no match of its own
    pairs = F.filter(
        F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), value.alias("value")),
        lambda x: x["whole"].isNotNull(),
    )

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: F.length(x["before"]) + F.length(x["whole"]))
        both = F.arrays_zip(pairs.alias("x"), running(sizes).alias("at"))

        def span(p):
            start = (p["at"] + F.length(p["x"]["before"])).cast("int")
            end = start + F.length(p["x"]["whole"])
            return F.struct(start.alias("start"), end.alias("end"), p["x"]["value"].alias("value"))

        return F.transform(F.filter(both, lambda p: F.length(p["x"]["value"]) >= least), span)

    return F.when(F.regexp_like(text, F.lit(pattern)), then(pairs, placed)).otherwise(empty)


def _log_bound(n: Column, share: Column, null: float, above: bool) -> Column:
    """Log of Chernoff's bound for a share of ``n`` draws as far above, or below, ``null``."""
    far = share > null if above else share < null
    rest = 1 - share
    part = F.when(share > 0, share * F.ln(share / null)).otherwise(0.0)
    other = F.when(rest > 0, rest * F.ln(rest / (1 - null))).otherwise(0.0)
    return F.when(far, -n * (part + other)).otherwise(0.0)


def evidence(value: Column) -> Column:
    """(p, random) of a run: its combined p-value as text, and whether it passes as random."""
    body = F.rtrim(value, F.lit("="))
    alphabet = F.coalesce(*[
        F.when(F.regexp_like(body, F.lit("^[" + symbols.replace("-", r"\-") + "]*$")), F.lit(symbols))
        for _, symbols in ALPHABETS
    ])

    def measured(x: Column) -> Column:
        codes, size = x["codes"], F.length(x["alphabet"]).cast("double")
        n = F.size(codes).cast("double")
        number = lambda a: a.cast("double")
        squares = F.aggregate(
            F.array_distinct(codes), F.lit(0.0),
            lambda done, c: done + F.pow(number(F.size(F.filter(codes, lambda d: d == c))), F.lit(2)),
        )
        pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes)).alias("b"))
        count = lambda test: number(F.size(F.filter(pairs, test)))
        middle = (size - 1) / 2
        chi = (size * squares / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        halves = count(lambda p: (p["a"] > middle) != (p["b"] > middle))
        runs = (halves - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        spread = (size * size - 1) / 12
        product = F.aggregate(pairs, F.lit(0.0), lambda done, p: done + (p["a"] - middle) * (p["b"] - middle))
        serial = product / (spread * F.sqrt(n - 1))
        sort = lambda c: F.ascii(F.regexp_replace(F.regexp_replace(F.regexp_replace(
            c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"))
        sorts = F.transform(x["chars"], sort)
        turns = F.aggregate(
            F.arrays_zip(F.slice(sorts, 1, F.size(sorts) - 1).alias("a"), F.slice(sorts, 2, F.size(sorts)).alias("b")),
            F.lit(0.0), lambda done, p: done + (p["a"] != p["b"]).cast("double"),
        )
        vowel = lambda c: F.ascii(F.regexp_replace(F.regexp_replace(
            F.lower(c), "[aeiouy]", "!"), "[b-z]", "\""))
        sounds = F.transform(x["chars"], vowel)
        letters = F.filter(
            F.arrays_zip(F.slice(sounds, 1, F.size(sounds) - 1).alias("a"), F.slice(sounds, 2, F.size(sounds)).alias("b")),
            lambda p: (p["a"] <= 34) & (p["b"] <= 34),
        )
        m = F.size(letters)
        swaps = number(F.size(F.filter(letters, lambda p: p["a"] != p["b"])))
        logs = (
            _log_bound(F.floor(n / 2), (squares - n) / (n * (n - 1)), EQUAL, above=False)
            + _log_bound(n - 1, turns / (n - 1), TURNS, above=True)
            + F.when(m > 0, _log_bound(m, swaps / F.greatest(m, F.lit(1)), SWAPS, above=False)).otherwise(0.0)
        )
        return then(-logs, lambda h: F.struct(
            (F.exp(-h) * (1 + h + h * h / 2)).alias("p"),
            ((chi <= FIT) & (F.abs(runs) <= FIT) & (F.abs(serial) <= FIT)).alias("random"),
        ))

    # each step is worked out once for the next one
    named = then(F.struct(body.alias("body"), alphabet.alias("alphabet")), lambda x: F.struct(
        x["alphabet"].alias("alphabet"), F.split(x["body"], "").alias("chars")
    ))
    coded = then(named, lambda x: F.struct(
        x["alphabet"].alias("alphabet"), x["chars"].alias("chars"),
        F.transform(x["chars"], lambda c: F.instr(x["alphabet"], c) - 1).alias("codes"),
    ))
    return then(coded, measured)


def _class_and_bin(run: Column) -> tuple[Column, Column]:
    size = run["end"] - run["start"]
    bin = F.least(F.floor(-2 * F.ln(F.greatest(run["p"], F.lit(1e-300)))), F.lit(BINS - 1)).cast("int")
    return F.floor(F.log2(size.cast("double"))).cast("int"), bin


def _base(text: Column) -> Column:
    """Known forms as an array of (start, kind number, end), sorted."""
    def numbered(kind: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))

    parts = [
        F.transform(_found(text, pattern, group, least), numbered(k))
        for k, (_, pattern, group, least) in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*parts))


def _replaced(text: Column, spans: Column, fill) -> Column:
    """The text with ``fill(span, end of the spans before it)`` in place of each span.

    Spans that overlap one another are taken for the part behind the earlier ones.
    """

    def joined(x: Column) -> Column:
        # four bytes for each code point: cutting at one does not count through the text
        part = lambda a, b: F.decode(F.substring(x["raw"], 4 * a + 1, 4 * (b - a)), "UTF-32")
        both = F.arrays_zip(x["spans"].alias("s"), x["before"].alias("before"))
        pieces = F.transform(
            both,
            lambda p: F.concat(
                F.when(p["s"]["start"] > p["before"], part(p["before"].cast("int"), p["s"]["start"])).otherwise(""),
                fill(p["s"], p["before"].cast("int")),
            ),
        )
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), part(end, F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    whole = F.struct(
        F.encode(text, "UTF-32").alias("raw"), spans.alias("spans"), running(ends, F.greatest).alias("before")
    )
    return F.when(F.size(spans) > 0, then(whole, joined)).otherwise(text)


def _runs(text: Column, base: Column) -> Column:
    """Runs, and parts of runs, beside the known forms: (start, end, p); p is 1 if the battery finds them not random."""
    def blank(s: Column, before: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0)))

    apart = then(_replaced(text, base, blank), lambda t: _found(t, RUN))
    tested = F.transform(
        apart, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), evidence(r["value"]).alias("e"))
    )
    return F.transform(
        tested,
        lambda r: F.struct(r["start"], r["end"], F.when(r["e"]["random"], r["e"]["p"]).otherwise(1.0).alias("p")),
    )


def _with_runs(docs: DataFrame, text: str, base: str, runs: str) -> DataFrame:
    whole = text_of(text)
    return docs.withColumn(base, _base(whole)).withColumn(runs, _runs(whole, F.col(base)))


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """For each class of lengths the least bin that the step-up rule accepts.

    At most 32 classes of ``BINS`` counts each are looked at; the driver gets one number
    per class.
    """
    runs = _with_runs(docs.select(F.col(text).alias("text")), "text", "base", "runs")
    each = runs.select(F.explode("runs").alias("r")).select(
        *[c.alias(n) for c, n in zip(_class_and_bin(F.col("r")), ("class", "bin"))]
    )
    counts = each.groupBy("class", "bin").agg(F.count("*").alias("n"))
    bins = counts.groupBy("class").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n")).alias("bins")
    )
    ranked = bins.select(
        "class",
        F.filter(
            "bins",
            lambda b: F.col("all") * F.exp(-b["bin"] / 2.0)
            <= rate * F.aggregate(
                "bins", F.lit(0).cast("bigint"),
                lambda done, c: done + F.when(c["bin"] >= b["bin"], c["n"]).otherwise(0),
            ),
        ).alias("passed"),
    )
    least = ranked.select("class", F.array_min(F.transform("passed", lambda b: b["bin"])).alias("least"))
    return {r["class"]: r["least"] for r in least.where("least is not null").collect()}


def with_secrets(
    docs: DataFrame, text: str = "text", column: str = "secrets", rate: float = RATE
) -> DataFrame:
    """``docs`` and ``column``, an array of (start, kind, end, name) sorted by start, then kind.

    A null or empty text has an empty array. The thresholds are set over all of
    ``docs``. Repeated rows each count. No rows: no rows. Other columns come back as
    they are; ``column`` must be new.
    """
    limits = thresholds(docs, text, rate)
    base, runs = fresh(docs, "base"), fresh(docs, "runs")
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))

    def accepted(run: Column) -> Column:
        size, bin = _class_and_bin(run)
        tests = [(size == c) & (bin >= b) for c, b in limits.items()]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    more = F.transform(
        F.filter(runs, accepted),
        lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), r["end"].alias("end")),
    )
    spans = F.transform(
        F.array_sort(F.concat(F.col(base), more)), lambda s: s.withField("name", names[s["kind"]])
    )
    return _with_runs(docs, text, base, runs).withColumn(column, spans).drop(base, runs)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or run of spans that overlap, replaced by ``MASK``. spans: sorted by start."""
    return _replaced(text, spans, lambda s, before: F.when(s["start"] >= before, F.lit(MASK)).otherwise(""))
