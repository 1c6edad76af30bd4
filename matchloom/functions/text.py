"""Text functions as Spark expressions.

All of them are total: a null string counts as the empty one. They stay in the
JVM; ``normalize_exact`` is the one Python function, for text that needs
Unicode compatibility forms.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Word lists that results depend on.
LEGAL = ("private", "limited", "ltd", "llp", "pvt", "inc", "incorporated", "corp", "corporation", "company", "co")
#: Words that say little about an address: the list in use, and what older variants add.
STOP = (
    "road", "rd", "street", "st", "lane", "ln", "floor", "fl", "building", "bldg", "house", "no", "number", "plot", "shop",
    "door", "near", "opp", "opposite", "district", "city", "state",
)
STOP_FOLD = (*STOP, "h")
STOP_FIRST = (*STOP, "h", "india")
STOP_SCRIPT = (
    "road", "rd", "street", "st", "floor", "plot", "house", "hno", "door", "no", "number", "near", "opp", "opposite", "block",
    "sector", "office", "room", "flat", "building", "bldg", "city", "district", "region", "india", "null",
)


#: First digits of the scripts whose digits count as such: ten code points each.
ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xFF10)
DIGITS = ("".join(chr(z + d) for z in ZEROS for d in range(10)), "0123456789" * len(ZEROS))


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize(c: Column | str) -> Column:
    """Case folded, ``&`` spelled out, everything but letters, digits and underscores as single spaces.

    Combining marks are not letters here, so scripts that use them fall apart
    at the marks; later functions count on that.
    """
    x = F.replace(F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def plain(value: str) -> str:
    """``normalize`` in Python, with compatibility forms (NFKC) and full case folding."""
    x = unicodedata.normalize("NFKC", value).casefold().replace("&", " and ")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x)).strip()


@F.pandas_udf(StringType())
def normalize_exact(values: pd.Series) -> pd.Series:
    return values.fillna("").map(plain)


def normalize_full(c: Column | str) -> Column:
    """The exact normalization: text outside ASCII goes through ``normalize_exact``, all other text stays in the JVM."""
    other = contains_non_ascii(c)
    return F.when(other, normalize_exact(F.when(other, text(c)))).otherwise(normalize(c))


def tokens(norm: Column | str) -> Column:
    """Tokens of a normalized string, in order."""
    return F.filter(F.split(text(norm), " "), lambda t: t != "")


def token_set(norm: Column | str) -> Column:
    return F.array_distinct(tokens(norm))


def words_array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def meaningful_tokens(norm: Column | str) -> Column:
    """Distinct tokens that are no legal forms."""
    return F.array_except(token_set(norm), words_array(LEGAL))


def without_legal_forms(norm: Column | str) -> Column:
    return F.array_join(F.filter(tokens(norm), lambda t: ~t.isin(*LEGAL)), " ")


def runs(letters: Column, n: int) -> Column:
    """All runs of ``n`` neighbours of an array of strings, joined. Shifted copies are zipped, so a long text costs its length."""
    out = letters
    for j in range(1, n):
        out = F.zip_with(out, F.slice(letters, j + 1, F.greatest(F.size(letters), F.lit(1))), lambda x, y: F.concat(x, y))
    return F.array_compact(out)


def char_ngrams(norm: Column | str, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters of the string without its spaces; a shorter one is its own."""
    joined = F.replace(text(norm), F.lit(" "), F.lit(""))
    short = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.array(joined))
    return F.when(F.length(joined) < n, short).otherwise(F.array_distinct(runs(F.split(joined, ""), n)))


def boundary_grams(norm: Column | str, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` characters inside tokens padded with a space on both sides, repeats kept."""

    def of(token: Column) -> Column:
        padded = F.concat(F.lit(" "), token, F.lit(" "))
        size = F.length(padded)

        def cut(n: int) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
            # A padded token no longer than the run stands for itself, once.
            return found if n == low else F.when(size >= n, found).otherwise(F.array().cast("array<string>"))

        return F.concat(*[cut(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(tokens(norm), of))


def ascii_digits(norm: Column | str) -> Column:
    """The string with the digits of other scripts as 0 to 9."""
    return F.translate(text(norm), *DIGITS)


def ordered_numbers(norm: Column | str) -> Column:
    """Runs of digits in order, without leading zeros."""
    found = F.regexp_extract_all(ascii_digits(norm), F.lit(r"([0-9]+)"), F.lit(1))
    return F.transform(found, canonical_number)


def numbers(norm: Column | str) -> Column:
    return F.array_distinct(ordered_numbers(norm))


def raw_numbers(norm: Column | str) -> Column:
    """Distinct runs of digits as they are written."""
    return F.array_distinct(F.regexp_extract_all(text(norm), F.lit(r"(?U)(\d+)"), F.lit(1)))


def canonical_number(token: Column) -> Column:
    """A run of digits without leading zeros; other tokens unchanged."""
    return F.when(token.rlike("^[0-9]+$"), F.regexp_replace(token, "^0+(?=[0-9])", "")).otherwise(token)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0 if both sets are empty."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(overlap(a, b) / all_)


def containment(shared: Column, base: Column) -> Column:
    """Shared over the base's size, 0 for an empty base."""
    return F.when(base == 0, F.lit(0.0)).otherwise(shared / base)


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer; 1 if both are empty, 0 if one is."""
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(F.least(x, y) / F.greatest(x, y))


def address_tokens(norm: Column | str, stop: tuple[str, ...] = STOP, least: int = 2) -> Column:
    """Distinct tokens of an address that are neither stop words nor numbers, of ``least`` characters or more."""
    return F.filter(token_set(ascii_digits(norm)), lambda t: ~t.isin(*stop) & ~t.rlike("^[0-9]+$") & (F.length(t) >= least))


def contains_non_ascii(c: Column | str) -> Column:
    return text(c).rlike(r"[^\x00-\x7F]")


def token_prefix(token: Column) -> Column:
    """``p:`` and the first two letters or digits of a token; null for one without."""
    clean = F.regexp_replace(token, r"(?U)[^\p{L}\p{N}]", "")
    return F.when(clean != "", F.concat(F.lit("p:"), F.substring(clean, 1, 2)))


def name_keys(norm: Column | str) -> Column:
    """Routing keys of a name: the beginnings of its meaningful tokens."""
    return F.array_distinct(F.array_compact(F.transform(meaningful_tokens(norm), token_prefix)))


def address_keys(norm: Column | str, stop: tuple[str, ...] = STOP) -> Column:
    """Routing keys of an address: its numbers, and the beginnings of its other tokens."""
    kept = F.filter(token_set(ascii_digits(norm)), lambda t: ~t.isin(*stop))
    key = lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("n:"), canonical_number(t))).otherwise(token_prefix(t))
    return F.array_distinct(F.array_compact(F.transform(kept, key)))


def path_name(country: Column | str) -> Column:
    """A country's name as a folder's."""
    return F.translate(text(country), "/ ", "__")


def hash_fraction(value: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from the first half of md5(seed:value)."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text(value)).cast("binary")), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def entity_split(value: Column | str, share: float = 0.3, seed: int = 42) -> Column:
    """train or val for the pairs of an entity, all on one side; drawn apart from ``split_name``."""
    return split_name(F.concat(F.lit("entity:"), text(value)), share, seed)


def split_name(value: Column | str, share: float = 0.2, seed: int = 42) -> Column:
    return F.when(hash_fraction(value, seed) < share, "val").otherwise("train")


def match_bucket(n: Column) -> Column:
    """0 to 4, and 5+."""
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))


def id_list(csv: Column | str) -> Column:
    """Ids of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text(csv), ","), lambda x: F.trim(x)), lambda x: x != "")


def register(spark: SparkSession) -> None:
    """Make the exact normalization callable from SQL."""
    from .fuzzy import lexical_similarity, ratio, token_set_ratio, token_sort_ratio
    from .translit import transliterate

    for name, function in {
        "normalize_exact": normalize_exact,
        "fuzzy_ratio": ratio,
        "token_sort_ratio": token_sort_ratio,
        "token_set_ratio": token_set_ratio,
        "lexical_similarity": lexical_similarity,
        "transliterate": transliterate,
    }.items():
        spark.udf.register(name, function)
