"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Patterns find assignments, access keys and long hexadecimal runs. Besides, every
long token of letters, digits and ``+/_-`` is tested (without the ``=`` that may fill it up). Its encoding is inferred
(hexadecimal, base 32 or base 64). Three tests ask whether the token could be
random in that encoding, and drop it if one says no: chi-squared uniformity of
its symbols, the number of runs of one character class, and the correlation of
neighbouring symbols. Two of them also measure how far it is from what people
write: symbols of one class only, and rare changes of class. Their standard
scores are combined (Stouffer), and the tokens of a stratum (encoding and length)
that are reported are those above the level at which, by Benjamini and
Hochberg, the false share is at most ``FALSE_SHARE``. Longer tokens carry more
evidence and have levels of their own. Scores are counted in steps of an
eighth, so a stratum's level follows from a small table of counts over all rows.

Everything here is DataFrame operations, and local to a row but for those counts.
Positions count code points; ends are exclusive.

Nulls: a null text is empty. A null id is kept. Rows that repeat are rows of
their own. Ties: spans of one start come in the order of their kinds. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# The patterns as they are given.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Of ``[0-9a-f]+``: a run too short to count is passed over at once; the runs found are the same.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_SHARE = 0.01
#: Standard scores beyond which a test says a token is not random.
REJECT = 3.5
#: Chance that neighbours differ in class in written names and paths.
CHANGES = 0.2
#: encoding: pattern, symbols, symbols of its largest class.
ENCODINGS = {"hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 10), "base32": (r"^[A-Z2-7]+=*$", 32, 26), "base64": (r"", 64, 26)}
#: Lower ends of the lengths that form strata.
LENGTHS = (20, 28, 40, 64)
STEP = 0.125
#: Pieces of a text whose places are found together.
BLOCK = 64


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, s), from the pieces of text between them.

    Pieces are taken ``BLOCK`` at a time: the lengths of whole blocks are added up first, then each block's own pieces,
    so the work grows with the matches and not with their square.
    """
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, found, lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s")))  # the last gap has no match
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))
    blocks = F.element_at(F.transform(F.array(pieces), cut), 1)  # the pieces as a bound name, found once and not for every block
    extent = lambda x: x["gap"] + F.coalesce(F.length(x["s"]), F.lit(0))

    def follow(state: Column, block: Column) -> Column:
        """The blocks so far, each with where it starts."""
        entry = F.struct(state["at"].alias("at"), block.alias("block"))
        return F.struct(
            F.aggregate(block, state["at"], lambda n, x: n + extent(x)).alias("at"),
            F.array_append(state["out"], entry).alias("out"),
        )

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["s"]), F.lit(0))
        new = F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s"))
        return F.struct(end.alias("at"), F.when(x["s"].isNull(), state["out"]).otherwise(F.array_append(state["out"], new)).alias("out"))

    empty = F.array().cast("array<struct<at:int,block:array<struct<gap:int,s:string>>>>")
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), follow, lambda s: s["out"])
    walk = F.flatten(F.transform(placed, lambda z: F.aggregate(z["block"], F.struct(z["at"].alias("at"), none.alias("out")), add, lambda s: s["out"])))
    return F.when(text.rlike(pattern), walk).otherwise(none)


def kept(found: Column, kind: str) -> Column:
    if kind == "assign":
        return F.filter(found, lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 2)) >= LEAST[kind])
    return F.filter(found, lambda m: F.length(m["s"]) >= LEAST[kind])


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def battery(span: Column) -> Column:
    """struct(stratum, level) of a token: encoding and length, and its combined score in steps (null: not random)."""
    token = F.rtrim(span, F.lit("="))
    n = F.length(token).cast("double")
    letters = F.split(token, "")

    def tally(s: Column, c: Column) -> Column:
        run = F.when(c == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("last"), run.alias("run"), (s["squares"] + 2 * run - 1).cast("double").alias("squares"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("squares"))
    squares = F.aggregate(F.array_sort(letters), start, tally, lambda s: s["squares"])  # sum of squared symbol counts

    def lag(s: Column, c: Column) -> Column:
        x = F.ascii(c).cast("double")
        return F.struct(x.alias("last"), (s["x"] + x).alias("x"), (s["xx"] + x * x).alias("xx"), (s["xy"] + s["last"] * x).alias("xy"))

    zero = F.lit(0.0)
    moments = F.aggregate(letters, F.struct(zero.alias("last"), zero.alias("x"), zero.alias("xx"), zero.alias("xy")), lag)
    changes = F.size(F.regexp_extract_all(token, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))) - 1
    code = F.when(token.rlike(ENCODINGS["hex"][0]), 0).when(token.rlike(ENCODINGS["base32"][0]), 1).otherwise(2)
    names = list(ENCODINGS)
    base = F.struct(n.alias("n"), squares.alias("q"), moments.alias("m"), changes.cast("double").alias("c"), code.alias("e"))

    def scored(b: Column) -> Column:
        pick = lambda i: F.element_at(F.array(*[F.lit(float(ENCODINGS[x][i])) for x in names]), b["e"] + 1)
        k, own, size = pick(1), pick(2), b["n"]
        chi = k / size * b["q"] - size
        uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (size - 1) / size)
        written = k + k * (size - 1) / own - size
        spread = k / size * 2 * F.sqrt(size * (size - 1) / 2 / own * (1 - 1 / own))
        even = (written - chi) / spread
        rates = F.element_at(F.array(*[F.lit(x) for x in (0.46875, 0.3046875, 0.634765625)]), b["e"] + 1)  # of random tokens
        runs = (b["c"] - (size - 1) * rates) / F.sqrt((size - 1) * rates * (1 - rates))
        mixed = (b["c"] - (size - 1) * CHANGES) / F.sqrt((size - 1) * CHANGES * (1 - CHANGES))
        mean = b["m"]["x"] / size
        var = b["m"]["xx"] / size - mean * mean
        serial = F.when(var > 1e-9, (b["m"]["xy"] / (size - 1) - mean * mean) / var * F.sqrt(size)).otherwise(F.lit(99.0))
        random = (uniform <= REJECT) & (F.abs(runs) <= REJECT) & (F.abs(serial) <= REJECT)
        band = sum((size >= x).cast("int") for x in LENGTHS[1:])
        level = F.floor((even + mixed) / math.sqrt(2) / STEP).cast("int")
        return F.struct((b["e"] * len(LENGTHS) + band).alias("stratum"), F.when(random, level).alias("level"))

    return F.element_at(F.transform(F.array(base), scored), 1)


def levels(rows: DataFrame) -> list[tuple[int, int]]:
    """The least level reported in each stratum, from the counts of levels over all rows; strata without any are left out."""
    counts = rows.select(F.explode("tokens.b").alias("b")).groupBy("b.stratum", F.coalesce("b.level", F.lit(-(2**30))).alias("level")).agg(F.count("*").alias("n"))
    # Standard scores of bounded tokens: a few hundred levels in each of twelve strata.
    by: dict[int, list[tuple[int, int]]] = {}
    for r in counts.collect():
        by.setdefault(r["stratum"], []).append((r["level"], r["n"]))
    out = []
    for stratum, own in sorted(by.items()):
        total, above, best = sum(n for _, n in own), 0, None
        for level, n in sorted(own, reverse=True):
            above += n
            z = level * STEP
            if z > 0 and total * 0.5 * math.exp(-z * z / 2) <= FALSE_SHARE * above:
                best = level
        if best is not None:
            out.append((stratum, best))
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the patterns' matches, the digest of their spans, and all spans, for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        *[as_spans(kept(matches(F.col("text"), p), k), k).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX), strict=False)],
        matches(F.col("text"), TOKEN).alias("t"),
    )
    tested = saved(
        found.select(
            "doc_id", *KINDS[:3], F.transform("t", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["s"]).alias("b"))).alias("tokens")
        )
    )
    least = levels(tested)
    passes = lambda b: F.coalesce(
        *[F.when(b["stratum"] == s, b["level"] >= x) for s, x in least], F.lit(False)
    )
    random = F.transform(
        F.filter("tokens", lambda m: passes(m["b"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end")),
    )
    named = F.array(*[F.lit(k) for k in KINDS])

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"], s["end"])), ",")

    base = F.concat(*KINDS[:3])
    return tested.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.concat(base, random)).alias("spans"),
    )
