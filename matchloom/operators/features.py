"""Features of candidate pairs: one projection over a join of prepared records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import ratio_struct
from ..functions.translit import transliterate
from ..sources.io import apart, stored

PROVENANCE = (
    "from_name_blocker", "from_address_blocker", "from_structured_blocker", "from_embedding_blocker",
    "blocker_count", "name_retrieval_score", "address_retrieval_score", "embedding_rank",
)
VOLUME = 4 << 20


def registry(rows: DataFrame) -> DataFrame:
    """id, country, name and address (normalized) and raw_name of source records (entity_id, business_name, business_address, country)."""
    return rows.select(
        F.col("entity_id").alias("id"),
        T.text("country").alias("country"),
        T.normalize_full("business_name").alias("name"),
        T.normalize_full("business_address").alias("address"),
        T.text("business_name").alias("raw_name"),
    )


def prepared(rows: DataFrame, side: str, spelled: str = "raw_name") -> DataFrame:
    """What the features need of a record, computed once per record and not per pair: one struct named ``side``.

    ``spelled`` is the column that is spelled in Latin letters.
    """
    return rows.select(
        F.col("id").alias(f"{side}_id"),
        F.struct(
            F.col("name"),
            F.col("address"),
            T.without_legal_forms("name").alias("bare"),
            transliterate(spelled).alias("latin"),
            T.token_set("name").alias("tokens"),
            T.meaningful_tokens("name").alias("meaningful"),
            T.char_ngrams("name").alias("grams"),
            T.token_set("address").alias("places"),
            T.numbers("address").alias("numbers"),
            T.ordered_numbers("address").alias("ordered"),
        ).alias(side),
    )


def flag(condition: Column) -> Column:
    return condition.cast("int")


def plain_features(a: Column, b: Column) -> dict[str, Column]:
    """Features that built-in functions express."""
    size = F.size

    def jaccard(shared: Column, field: str) -> Column:
        """As ``T.jaccard``: the fields are sets, so their sizes and what they share tell how many all are."""
        every = size(a[field]) + size(b[field]) - shared
        return F.when(every == 0, F.lit(0.0)).otherwise(shared / every)

    shared, meaningful = T.overlap(a["tokens"], b["tokens"]), T.overlap(a["meaningful"], b["meaningful"])
    numbers = T.overlap(a["numbers"], b["numbers"])
    both = (size(a["numbers"]) > 0) & (size(b["numbers"]) > 0)
    ordered = (size(a["ordered"]) > 0) & (size(b["ordered"]) > 0)
    first = F.get(a["ordered"], F.lit(0)) == F.get(b["ordered"], F.lit(0))
    equal_sets = (numbers == size(a["numbers"])) & (numbers == size(b["numbers"])) & both
    return {
        "name_exact": flag((a["name"] == b["name"]) & (a["name"] != "")),
        "name_token_jaccard": jaccard(shared, "tokens"),
        "name_length_ratio": T.length_ratio(a["name"], b["name"]),
        "name_token_count_s1": size(a["tokens"]),
        "name_token_count_s2": size(b["tokens"]),
        "shared_name_token_count": shared.cast("int"),
        "s1_name_containment": T.containment(shared, size(a["tokens"])),
        "s2_name_containment": T.containment(shared, size(b["tokens"])),
        "meaningful_name_token_count_s1": size(a["meaningful"]),
        "meaningful_name_token_count_s2": size(b["meaningful"]),
        "shared_meaningful_name_tokens": meaningful.cast("int"),
        "extra_meaningful_tokens_s1": (size(a["meaningful"]) - meaningful).cast("int"),
        "extra_meaningful_tokens_s2": (size(b["meaningful"]) - meaningful).cast("int"),
        "meaningful_s1_containment": T.containment(meaningful, size(a["meaningful"])),
        "meaningful_s2_containment": T.containment(meaningful, size(b["meaningful"])),
        "name_char_3gram_jaccard": jaccard(T.overlap(a["grams"], b["grams"]), "grams"),
        "address_exact": flag((a["address"] == b["address"]) & (a["address"] != "")),
        "address_token_jaccard": jaccard(T.overlap(a["places"], b["places"]), "places"),
        "address_length_ratio": T.length_ratio(a["address"], b["address"]),
        "s1_address_missing": flag(a["address"] == ""),
        "s2_address_missing": flag(b["address"] == ""),
        "shared_number_count": numbers.cast("int"),
        "number_jaccard": jaccard(numbers, "numbers"),
        "number_exact_set": flag(equal_sets),
        "both_have_numbers": flag(both),
        "number_conflict": flag(both & (numbers == 0)),
        "ordered_number_exact": flag((a["ordered"] == b["ordered"]) & ordered),
        "first_number_match": flag(F.coalesce(first & ordered, F.lit(False))),
        "first_number_conflict": flag(F.coalesce(~first & ordered, F.lit(False))),
    }


#: The features that are ratios, with the kind of ratio and the field of the prepared records.
RATIOS = {
    "name_ratio": ("ratio", "name"), "name_token_sort": ("sort", "name"), "name_token_set": ("set", "name"),
    "legal_suffix_stripped_ratio": ("ratio", "bare"), "legal_suffix_stripped_token_set": ("set", "bare"),
    "translit_name_ratio": ("ratio", "latin"), "translit_name_token_sort": ("sort", "latin"), "translit_name_token_set": ("set", "latin"),
    "address_ratio": ("ratio", "address"), "address_token_sort": ("sort", "address"), "address_token_set": ("set", "address"),
}
ratios = ratio_struct(RATIOS)


def ratio_fields(a: Column, b: Column) -> Column:
    """What ``ratios`` takes, from two prepared records."""
    fields = sorted({field for _, field in RATIOS.values()})
    return F.struct(*[side[f].alias(f"{f}_{name}") for f in fields for side, name in ((a, "a"), (b, "b"))])


def blocks(rows: DataFrame, block: int) -> int:
    """How many blocks of about ``block`` records, and ``VOLUME`` characters of names and addresses, a registry is cut into."""
    n, characters = rows.agg(F.count("*"), F.sum(F.length("name") + F.length("address"))).first()
    return max(1, -(-n // block), -(-(characters or 0) // VOLUME))


def own_partitions(spark: SparkSession, n: int) -> Column:
    """An array of ``n`` whole numbers that a repartition into ``n`` deals to a partition each."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")
    rows = spark.range(n * (8 + 2 * n.bit_length())).select("id", place).groupBy("place").agg(F.min("id").alias("id")).collect()
    names = {r["place"]: r["id"] for r in rows}
    return F.array(*[F.lit(names.get(i, i)).cast("int") for i in range(n)])


def joined(pairs: DataFrame, left: DataFrame, right: DataFrame, target_spelling: str = "raw_name", block: int = 32768) -> DataFrame:
    """The pairs (q_id, c_id and what else they have) with both prepared records. Fails at a pair whose record is not there.

    Both registries are cut into blocks by id, and the pairs of two blocks meet both in one task. So a record travels once
    for every block of the other side, not with each of its pairs, and only the ids and columns of the pairs move. Pairs
    and prepared records are written first; the joins are planned in a session of their own (``io.apart``).
    """
    spark = pairs.sparkSession
    cn = blocks(right, block)
    qn = max(blocks(left, block), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // cn))
    # All three are dealt by the cell alone, which joins by cell and id keep only with this setting: neither moves a row.
    own = apart(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    pairs, q, c = (stored(rows, own) for rows in (pairs, prepared(left, "q"), prepared(right, "c", target_spelling)))
    number = lambda n, of: F.pmod(F.xxhash64(of), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = own_partitions(own, qn * cn)

    def dealt(rows: DataFrame, qb: Column, cb: Column) -> DataFrame:
        cell = F.element_at(names, (F.col("__qb") * cn + F.col("__cb") + 1).cast("int"))
        return rows.select("*", qb.alias("__qb")).select("*", cb.alias("__cb")).withColumn("__cell", cell).drop("__qb", "__cb").repartition(qn * cn, "__cell")

    both = dealt(pairs, number(qn, "q_id"), number(cn, "c_id"))
    both = both.join(dealt(q, number(qn, "q_id"), every(cn)).hint("shuffle_hash"), ["__cell", "q_id"], "left")
    both = both.join(dealt(c, every(qn), number(cn, "c_id")).hint("shuffle_hash"), ["__cell", "c_id"], "left").drop("__cell")
    known = lambda side, id_: F.when(F.col(side).isNotNull(), F.col(side)).otherwise(F.raise_error(F.concat(F.lit("no record with the id "), F.col(id_).cast("string"))))
    return both.withColumns({"q": known("q", "q_id"), "c": known("c", "c_id")})


def provenance(pairs: DataFrame) -> dict[str, Column]:
    """Columns that tell where a pair comes from, 0 where the pair has none."""
    have = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in pairs.columns else F.lit(0)
    flags = PROVENANCE[:4]
    out = {c: have(c) for c in PROVENANCE if c != "blocker_count"}
    return out | {"blocker_count": sum((have(c) for c in flags[1:]), have(flags[0]))}


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame, target_spelling: str = "raw_name") -> DataFrame:
    """The pairs with all 48 features.

    Names of both sides are spelled in Latin letters from how they were written; with ``target_spelling`` "name" those
    of the targets are spelled from their normalized form, as older feature tables have them.
    """
    a, b = F.col("q"), F.col("c")
    columns = plain_features(a, b) | {name: F.col(f"ratios.{name}") for name in RATIOS} | provenance(pairs)
    rest = [c for c in pairs.columns if c not in ("q_id", "c_id", *columns)]
    both = joined(pairs, left, right, target_spelling).withColumn("ratios", ratios(ratio_fields(a, b)))
    return both.select("q_id", "c_id", *rest, *[v.alias(k) for k, v in columns.items()])


def feature_names(table: DataFrame) -> list[str]:
    known = ("q_id", "c_id", "label", "split", "country", "source", "structured_retrieval_score")
    return [c for c in table.columns if c not in known]


def interactions(f: DataFrame) -> DataFrame:
    """18 combinations of features: eight flags for pairs that one side speaks for, and ten products and extremes."""
    c = F.col
    aj, as_, ns, nr = c("address_token_jaccard"), c("address_token_set"), c("name_token_set"), c("name_ratio")
    nj, tr, ts = c("number_jaccard"), c("translit_name_ratio"), c("translit_name_token_set")
    columns = {
        "strong_address_weak_name": flag((aj >= 0.8) & (nr < 0.6)),
        "strong_name_weak_address": flag((ns >= 0.9) & (aj < 0.3)),
        "address_number_agreement": flag((aj >= 0.8) & (nj >= 0.8)),
        "high_address_low_name": flag((as_ >= 0.9) & (ns < 0.6)),
        "translit_rescue": flag((tr >= 0.8) & (nr < 0.5)),
        "translit_address_rescue": flag((ts >= 0.8) & (as_ >= 0.8) & (nr < 0.6)),
        "strong_address_number_name_conflict": flag((aj >= 0.8) & (nj >= 0.8) & (ns < 0.5)),
        "strong_name_number_conflict": flag((ns >= 0.9) & (c("number_conflict") == 1)),
        "address_x_number": aj * nj,
        "address_set_x_number": as_ * nj,
        "name_x_address": ns * as_,
        "name_jaccard_x_address_jaccard": c("name_token_jaccard") * aj,
        "translit_x_address": ts * as_,
        "translit_ratio_x_address_jaccard": tr * aj,
        "meaningful_name_x_address": c("meaningful_s1_containment") * c("meaningful_s2_containment") * as_,
        "name_address_min": F.least(ns, as_),
        "name_address_max": F.greatest(ns, as_),
        "name_address_abs_diff": F.abs(ns - as_),
    }
    return f.withColumns(columns)
