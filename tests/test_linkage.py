"""Retrieval, features, evaluation, sources and streams on small data, and laws they must keep."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions.fuzzy import plain_ratio
from matchloom.operators import evaluation as E
from matchloom.operators import blockers, features, learning, relational, retrieval
from matchloom.plans import linkage, tables
from matchloom.sources import io
from matchloom.streaming.topk import TopKTable, stateful_top_k

SF = "/root/testdata/sf0.001"
S1 = [
    ("S1-1", "Star Technologies Private Limited", "27 Amratolsa Street, Kolkata", "India"),
    ("S1-2", "North Investment", "5 Lake Road", "India"),
    ("S1-3", "Blue Bolt Inc", "", "US"),
    ("S1-4", "", "", "US"),
]
S2 = [
    ("S2-1", "STAR TECHNOLOGIES PRIVATE LIMITED", "47 Amratolsa Street, Kolkata", "India"),
    ("S2-2", "नॉर्थ इन्वेस्टमेंट", "5 Lake Rd", "India"),
    ("S2-3", "Blue Bolt", "12 Main St", "US"),
    ("S2-4", "Blue Bolt Inc", "", "India"),
]
COLUMNS = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame(S1, COLUMNS)


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame(S2, COLUMNS)


@pytest.fixture(scope="module")
def both(left, right):
    return features.registry(left).cache(), features.registry(right).cache()


def test_features(spark, both):
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-3", "S2-3"), ("S1-4", "S2-4")], "q_id string, c_id string")
    table = features.pair_features(pairs, *both)
    assert len(features.feature_names(table)) == 48
    rows = {r.q_id: r for r in table.collect()}
    one = rows["S1-1"]
    assert one.name_ratio == 1 and one.number_conflict == 1 and one.address_token_jaccard == pytest.approx(3 / 5) and one.name_exact == 1
    assert one.meaningful_name_token_count_s1 == 2 and one.first_number_conflict == 1 and one.both_have_numbers == 1
    two = rows["S1-2"]
    assert two.translit_name_ratio > 0.8 > 0.5 > two.name_ratio and two.first_number_match == 1
    three = rows["S1-3"]
    assert three.legal_suffix_stripped_ratio == 1 and three.s1_address_missing == 1 and three.address_length_ratio == 0 and three.address_token_set == 0
    four = rows["S1-4"]
    assert four.name_exact == 0 and four.name_token_jaccard == 0 and four.name_length_ratio == 0 and four.address_length_ratio == 1 and four.address_ratio == 1
    more = features.interactions(table)
    assert len(more.columns) - len(table.columns) == 18
    assert {r.q_id: r.translit_rescue for r in more.collect()}["S1-2"] == 1


def test_matches_stay_in_their_country(both):
    for rows in (retrieval.exact_pairs(*both), blockers.hybrid(*both)):
        country = {i: c for i, *_, c in [*S1, *S2]}
        assert all(country[r.q_id] == country[r.c_id] for r in rows.collect())


def cosines(queries, targets, low, high, k):
    def weights(s):
        count = Counter()
        for t in s.split():
            p = f" {t} "
            for n in range(low, high + 1):
                if len(p) >= n or n == low:
                    count.update([p[i : i + n] for i in range(max(len(p) - n + 1, 1))])
        norm = math.sqrt(sum(v * v for v in count.values()))
        return {g: v / norm for g, v in count.items()}

    out = []
    weigh = {i: weights(s) for i, _, s in [*queries, *targets]}
    for q, c, _ in queries:
        scored = []
        for o, d, _ in targets:
            if c == d:
                s = round(sum(v * weigh[o].get(g, 0) for g, v in weigh[q].items()), 6)
                if s > 0:
                    scored.append((-s, o))
        out += [(q, o, -s) for s, o in sorted(scored)[:k]]
    return sorted(out)


def test_cosine_search(spark):
    a, b = (x.cache() for x in tables.sides(spark, SF))
    got = sorted((r.q_id, r.c_id, r.score) for r in retrieval.cosine_top_k(a, b, "address", (3, 5), 5).collect())
    rows = lambda x: [(r.id, r.country, r.address) for r in x.collect()]
    want = cosines(rows(a), rows(b), 3, 5, 5)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_routed_is_part_of_full(spark):
    a, b = (x.cache() for x in tables.sides(spark, SF))
    full = {(r.q_id, r.c_id): r.score for r in retrieval.cosine_top_k(a, b, "address", (3, 5), 1000).collect()}
    routed = {(r.q_id, r.c_id): r.score for r in retrieval.routed_top_k(a, b, "address", (3, 5), 1000).collect()}
    assert routed and set(routed) <= set(full)
    assert all(abs(full[p] - s) < 2e-6 for p, s in routed.items())


def test_top_k_grows_with_k(spark):
    a, b = (x.cache() for x in tables.sides(spark, SF))
    pairs = [{(r.q_id, r.c_id) for r in retrieval.structured_top_k(a, b, k).collect()} for k in (2, 5, 50)]
    assert pairs[0] <= pairs[1] <= pairs[2]


def test_rerank(spark, both):
    pool = retrieval.structured_top_k(*both, 100)
    rows = {(r.q_id, r.c_id): r.score for r in retrieval.rerank(pool, *both, 25, "max").collect()}
    name = T.plain
    assert rows["S1-1", "S2-1"] == pytest.approx(1.0, abs=1e-5)
    plain = plain_ratio(name("North Investment"), name("नॉर्थ इन्वेस्टमेंट")) / 100
    spelled = plain_ratio("north investment", "nonrth investtmentt") / 100
    assert rows["S1-2", "S2-2"] == pytest.approx(0.5 + 0.35 * spelled + 0.15 * plain, abs=1e-5)
    for form in ("lexical", "range"):
        assert retrieval.rerank(pool, *both, 25, form).count() == len(rows)


def test_transliterated_search_covers_all_turns(spark):
    from matchloom.functions.translit import transliterate
    from matchloom.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    turns = Q.table(spark, sf, "conversations").withColumn("latin", transliterate("text"))
    turns = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text", T.boundary_grams("latin", 3, 4).alias("g")).collect()
    grams = {r.id: Counter(r.g) for r in turns}
    norm = {i: sum(n * n for n in g.values()) ** 0.5 for i, g in grams.items()}
    targets = [r.id for r in turns if r.role != "user" and not r.text.isascii()]
    want = {}
    for q in (r.id for r in turns if r.role == "user"):
        scores = {c: sum(n * grams[c][g] for g, n in grams[q].items()) / (norm[q] * norm[c]) for c in targets}
        want |= {(q, c): s for c, s in sorted(scores.items(), key=lambda x: -x[1])[:20] if round(s, 6) > 0}
    got = {(r.q_id, r.c_id): r.score for r in Q.QUERIES["transliterated_top_k"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert any(q.split("-")[0] != c.split("-")[0] for q, c in got)


def test_fuzzy_ratios_cover_all_turns(spark):
    from matchloom.plans import queries as Q

    turns = {(r.conv_id, r.turn): r.n for r in Q.table(spark, SF, "conversations").select("conv_id", "turn", T.normalize("text").alias("n")).collect()}
    want = {(c, t): plain_ratio(turns[c, t - 1], n) for (c, t), n in turns.items() if (c, t - 1) in turns}
    rows = Q.QUERIES["fuzzy_ratios"](spark, SF).collect()
    assert len(rows) == len(want) == 67
    assert {(r.conv_id, r.turn): r.ratio for r in rows} == pytest.approx(want)


def test_blocked_search_is_the_full_search(both):
    args = (*both, "name", (3, 4), 2)
    whole = retrieval.cosine_top_k(*args).collect()
    assert whole and Counter(map(tuple, retrieval.blocked_cosine_top_k(*args, block=1, wide=2).select("q_id", "c_id", "score", "rank").collect())) == Counter((r.q_id, r.c_id, r.score, r["rank"]) for r in whole)


def test_transliterated_search(both):
    rows = retrieval.transliterated_top_k(*both).collect()
    assert [(r.q_id, r.c_id) for r in rows if r["rank"] == 1 and r.q_id == "S1-2"] == [("S1-2", "S2-2")]


def test_embedding_searches(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120).select(F.col("vec_id").alias("id"), "embedding").cache()
    exact = retrieval.embedding_top_k(rows, rows, 5, block=50).collect()
    vectors = {r.id: list(map(float, r.embedding)) for r in rows.collect()}
    for q in list(vectors)[:20]:
        scored = sorted((-round(sum(a * b for a, b in zip(vectors[q], v, strict=True)), 5), i) for i, v in vectors.items() if i != q)[:5]
        assert [(r.c_id, r.score) for r in sorted((r for r in exact if r.q_id == q), key=lambda r: r["rank"])] == [(i, pytest.approx(-s, abs=2e-5)) for s, i in scored]
    near = retrieval.embedding_top_k_approx(rows, 5).collect()
    found = {(r.q_id, r.c_id) for r in exact}
    assert len(found & {(r.q_id, r.c_id) for r in near}) >= 0.9 * len(found)


def test_cells_of_grouped_vectors(spark):
    """All vectors of the table, and vectors that form groups: recall at ten of 0.9, the latter from a tenth of the pairs."""
    import random

    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    grouped = spark.createDataFrame([(i, [x + rng.gauss(0, 0.15) for x in centres[i % 60]]) for i in range(1500)], "id long, embedding array<double>")
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    for rows in (grouped, table):
        exact = {(r.q_id, r.c_id) for r in retrieval.embedding_top_k(rows, rows, 10).collect()}
        near = {(r.q_id, r.c_id) for r in retrieval.embedding_top_k_approx(rows, 10).collect()}
        assert len(exact & near) >= 0.9 * len(exact)
    assert retrieval.embedding_top_k_approx(grouped.limit(0), 10).count() == 0


def test_routed_search_in_blocks(both):
    """Keys cut into blocks of one record give the same rows."""
    for kind, grams in (("name", retrieval.NAME_GRAMS), ("address", retrieval.ADDRESS_GRAMS)):
        rows = [Counter(map(tuple, retrieval.routed_top_k(*both, kind, grams, 5, block=b).select("q_id", "c_id", "score", "rank").collect())) for b in (1, 2048)]
        assert rows[0] == rows[1] and rows[0]


def test_full_width_and_folded_names_match(spark):
    wide = spark.createDataFrame([("S1-1", "ＡＣＭＥ Ｔｏｏｌｓ", "Straße 5", "X"), ("S1-2", "ﬁne ﬂour", "", "X"), ("S1-3", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    plain = spark.createDataFrame([("S2-1", "acme tools", "strasse 5", "X"), ("S2-2", "Fine Flour", "", "X")], "entity_id string, business_name string, business_address string, country string")
    left, right = features.registry(wide), features.registry(plain)
    assert {(r.q_id, r.c_id) for r in retrieval.exact_pairs(left, right).collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-2")}
    assert {r.id: r.name for r in left.collect()} == {"S1-1": "acme tools", "S1-2": "fine flour", "S1-3": ""}


def test_pair_without_a_record_fails(spark, both):
    from matchloom.operators.features import pair_features

    pairs = spark.createDataFrame([("S1-1", "nobody")], "q_id string, c_id string")
    with pytest.raises(Exception, match="no record with the id"):
        pair_features(pairs, *both).collect()


def test_target_spelling(spark):
    from matchloom.operators.features import pair_features

    rows = spark.createDataFrame([("a", "स्टार", "", "X")], "entity_id string, business_name string, business_address string, country string")
    one = features.registry(rows)
    pairs = spark.createDataFrame([("a", "a")], "q_id string, c_id string")
    assert pair_features(pairs, one, one).first().translit_name_ratio == 1.0
    assert pair_features(pairs, one, one, "name").first().translit_name_ratio < 1.0


def test_f_half(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "q_id string")
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "q_id string, c_id string")
    scored = spark.createDataFrame([("a", "1", 0.9), ("a", "3", 0.6), ("c", "1", 0.9)], "q_id string, c_id string, probability double")
    rows = {r.threshold: r for r in E.entity_scores(entities, truth, scored, [0.5, 0.8, 0.95]).collect()}
    a = lambda tp, fp, fn: 1.25 * tp / (1.25 * tp + 0.25 * fn + fp)
    assert rows[0.5].f_half == pytest.approx((a(1, 1, 1) + 0 + 0 + 1) / 4, abs=1e-6)
    assert rows[0.8].f_half == pytest.approx((a(1, 0, 1) + 0 + 0 + 1) / 4, abs=1e-6)
    assert rows[0.95].f_half == pytest.approx((0 + 0 + 1 + 1) / 4)
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].fn) == (1, 2, 2)
    best, score = E.search_threshold(entities, truth, scored)
    assert score == max(r.f_half for r in E.entity_scores(entities, truth, scored, E.grid(0.05, 0.99, 0.01)).collect())
    o = E.oracle(entities, truth, scored).first()
    assert (o.tp, o.fn, o.recall) == (1, 2, pytest.approx(1 / 3, abs=1e-6)) and o.f_half == pytest.approx((a(1, 0, 1) + 0 + 1 + 1) / 4, abs=1e-6)


def test_curves(spark):
    import random

    rng = random.Random(7)
    rows = [(str(i), str(i), int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(500)]
    got = E.curves(spark.createDataFrame(rows, "q_id string, c_id string, label int, probability double")).first()
    positive, negative = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    area = sum((p > n) + (p == n) / 2 for p in positive for n in negative) / len(positive) / len(negative)
    ap, tp, fp = 0.0, 0, 0
    for level in sorted({r[3] for r in rows}, reverse=True):
        p, n = positive.count(level), negative.count(level)
        tp, fp = tp + p, fp + n
        ap += p / len(positive) * tp / (tp + fp)
    assert got.roc_auc == pytest.approx(area, abs=1e-6) and got.average_precision == pytest.approx(ap, abs=1e-6)


def test_relational(spark):
    lists = spark.createDataFrame([("a", " x, y,x"), ("b", ""), ("c", None)], "k string, ids string")
    long = relational.explode_ids(lists, "k", "ids", "id")
    assert sorted((r.k, r.id) for r in long.collect()) == [("a", "x"), ("a", "y")]
    back = {r.k: r.ids for r in relational.collapse_ids(lists, long, "k", "id", "ids").collect()}
    assert back == {"a": "x,y", "b": "", "c": ""}
    ordered = long.withColumn("o", F.when(F.col("id") == "y", 0).otherwise(1))
    assert {r.k: r.ids for r in relational.collapse_ids(lists, ordered, "k", "id", "ids", "o").collect()}["a"] == "y,x"
    with pytest.raises(ValueError, match="repeat"):
        relational.join_one_to_one(long, long, ["k"])
    with pytest.raises(ValueError, match="differ"):
        relational.join_one_to_one(lists, lists.limit(2).select("k"), ["k"])
    with pytest.raises(ValueError, match="no candidates"):
        relational.check_subset(long, long.limit(1), ["k", "id"])
    assert relational.missing_columns(lists, ["k", "z"]) == (["z"], ["ids"])
    assert relational.sample(long, "id", 1).collect() == relational.sample(long.repartition(3), "id", 1).collect()


def test_mining(spark):
    rows = [("q", f"c{i}", i / 100, int(i < 3), split) for split in ("train",) for i in range(40)] + [("v", f"c{i}", 0.5, 0, "val") for i in range(30)]
    pairs = spark.createDataFrame(rows, "q_id string, c_id string, name_retrieval_score double, label int, split string")
    pairs = pairs.withColumns({"address_retrieval_score": F.lit(0.0), "structured_retrieval_score": F.lit(0.0)} | {f"from_{c}_blocker": F.lit(1) for c in retrieval.CHANNELS})
    kept = E.mined(pairs, 20).collect()
    assert {r.c_id for r in kept if r.q_id == "q"} == {"c0", "c1", "c2"} | {f"c{i}" for i in range(20, 40)}
    assert sum(r.q_id == "v" for r in kept) == 30


def test_sources(spark, tmp_path, left, both):
    io.write_delimited(left, f"{tmp_path}/s.tsv")
    assert sorted(map(tuple, io.read_registry(spark, f"{tmp_path}/s.tsv").collect())) == sorted(S1)
    io.write_delimited(left, f"{tmp_path}/s.csv", ",")
    assert sorted(map(tuple, io.read_delimited(spark, f"{tmp_path}/s.csv", io.REGISTRY, ",").collect())) == sorted(S1)
    with pytest.raises(Exception):  # noqa: B017
        io.read_truth(spark, f"{tmp_path}/missing.tsv").count()
    for i in (1, 2, 3):
        io.write_delimited(left, f"{tmp_path}/bundle/source{i}.tsv")
    io.write_lists(spark.createDataFrame([("S1-1", "S2-1,S2-2"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string"), "source1_entity_id", "matched_entity_ids", f"{tmp_path}/bundle/ground_truth.tsv")
    bundle = io.read_bundle(spark, f"{tmp_path}/bundle")
    assert {k: v.count() for k, v in bundle.items()} == {"source1": 4, "source2": 4, "source3": 4, "truth": 2}
    assert {tuple(r) for r in bundle["truth"].collect()} == {("S1-1", "S2-1,S2-2"), ("S1-2", "")}
    spark.createDataFrame([("a", "Validation"), ("b", "train")], "entity_id string, set string").write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/splits.tsv")
    assert {tuple(r) for r in io.read_splits(spark, f"{tmp_path}/splits.tsv").collect()} == {("a", "val"), ("b", "train")}
    io.write_json(spark.createDataFrame([(1, 0.5)], "n int, x double"), f"{tmp_path}/meta.json")
    assert spark.read.json(f"{tmp_path}/meta.json").count() == 1


def test_resume(spark, tmp_path, left):
    keys = left.select("country").distinct()
    path = f"{tmp_path}/out"
    assert io.unfinished(keys, spark, path, ["country"]).count() == 2
    io.write_parquet(left.where("country = 'US'"), path, ("country",))
    assert [r.country for r in io.unfinished(keys, spark, path, ["country"]).collect()] == ["India"]
    io.write_parquet(left.where("country = 'India'"), path, ("country",))
    assert io.read_parts(spark, f"{path}/country=*", path).count() == 4


def test_index(spark, tmp_path, both):
    left, right = both
    blockers.Index.of(right).write(f"{tmp_path}/index")
    index = blockers.Index.read(spark, f"{tmp_path}/index")
    assert index.records.count() == 4
    assert [r.key for r in index.postings.where("country = 'US' and kind = 'number'").collect()] == ["12"]
    for blocker in (blockers.full_text, blockers.routed, blockers.hybrid, blockers.country, blockers.folded):
        direct, stored = (sorted(map(tuple, blocker(left, x).collect())) for x in (right, index))
        assert direct and direct == stored
    plan = index.postings.where("country = 'US'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "US" in plan.split("PartitionFilters: [")[1][:200]


def stream_pairs():
    import random

    rng = random.Random(11)
    return [(f"q{rng.randrange(5)}", f"c{rng.randrange(30)}", round(rng.random(), 3)) for _ in range(400)]


def best_by_hand(rows, k):
    top = defaultdict(dict)
    for q, c, s in rows:
        top[q][c] = max(s, top[q].get(c, s))
    return sorted((q, c, s) for q, own in top.items() for c, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k])


def test_stream(spark, tmp_path):
    rows = stream_pairs()
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], "q_id string, c_id string, score double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q_id string, c_id string, score double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = TopKTable(f"{tmp_path}/state", 4)
    table.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(map(tuple, table.read(spark).collect())) == best_by_hand(rows, 4)
    stateful = stateful_top_k(stream, 4).writeStream.format("memory").queryName("best").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    stateful.awaitTermination()
    out = spark.table("best").collect()
    assert set(best_by_hand(rows, 4)) <= {tuple(r) for r in out}


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """A new object on the same folder and checkpoint takes up what the first one left; a batch that is repeated changes nothing."""
    rows = stream_pairs()
    frame = lambda x: spark.createDataFrame(x, "q_id string, c_id string, score double")
    for half in (rows[:200], rows[200:]):
        frame(half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("q_id string, c_id string, score double").parquet(f"{tmp_path}/in")
        TopKTable(f"{tmp_path}/state", 4).follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    table = TopKTable(f"{tmp_path}/state", 4)
    assert sorted(map(tuple, table.read(spark).collect())) == best_by_hand(rows, 4)
    last = table.versions(spark)[-1]
    table.merge(frame(rows[200:]), last)
    assert table.versions(spark)[-1] == last and sorted(map(tuple, table.read(spark).collect())) == best_by_hand(rows, 4)


def test_merging_in_any_order(spark):
    rows = stream_pairs()
    frame = lambda x: spark.createDataFrame(x, "q_id string, c_id string, score double")
    one, two, three = frame(rows[:100]), frame(rows[100:250]), frame(rows[250:])
    m = retrieval.merge_top_k
    a = sorted(map(tuple, m(m(one, two, 4), three, 4).collect()))
    b = sorted(map(tuple, m(one, m(three, two, 4), 4).collect()))
    assert a == b == best_by_hand(rows, 4)


def test_learning(spark):
    left, right, truth = tables.customers(spark, SF), tables.suppliers(spark, SF), tables.truth(spark, SF)
    table = linkage.training_table(left, right, truth).cache()
    entities = left.select(F.col("entity_id").alias("q_id"))
    model, names, threshold, score = linkage.fit(table, entities, truth, rounds=5, depth=3)
    assert len(names) == 48 and 0 < threshold < 1 and 0 <= score <= 1
    assert learning.importance(model, names, spark).count() == 48
    lists = linkage.infer(model, names, threshold, left, right).collect()
    assert len(lists) == left.count()
    for r in lists:
        assert set(filter(None, r.matched_entity_ids.split(","))) <= set(r.candidate_entity_ids.split(","))


def texts(spark, side, rows):
    return spark.createDataFrame([(f"{side}{i}", "x", "", text) for i, text in rows], "id string, country string, name string, address string")


def test_full_search_with_copies(spark):
    """Large groups of equal texts on both sides: every query keeps its best, ties to the smaller id, and no pair of rows is shuffled."""
    words = ["5 lake road", "15 lake road", "7 hill street", "lake"]
    left = texts(spark, "q", [(i, words[i % 3]) for i in range(120)])
    right = texts(spark, "c", [(i, words[i % 4]) for i in range(200)])
    full = retrieval.cosine_top_k(left, right, "address", (3, 5), 7)
    parts = retrieval.blocked_cosine_top_k(left, right, "address", (3, 5), 7, block=16, wide=3)
    rows = [sorted(map(tuple, x.select("q_id", "rank", "c_id", "score").collect())) for x in (full, parts)]
    assert len(rows[0]) == 120 * 7 and rows[0] == rows[1]
    assert [c for q, _, c, _ in rows[0] if q == "q0"] == sorted(f"c{i}" for i in range(0, 200, 4))[:7]
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in plan and "Join" in plan and "SortMergeJoin" not in plan  # texts travel, not grams


def test_products_of_frequent_and_rare_grams():
    import numpy as np

    rng = np.random.default_rng(5)
    sides = [(rng.random((n, 60)) < np.linspace(0.005, 0.9, 60)) * rng.random((n, 60)) for n in (70, 90)]
    left, right = (retrieval.Sparse(len(x), *np.nonzero(x), x[np.nonzero(x)]) for x in sides)
    for cells, wide in ((1 << 21, None), (200, 7), (1, 1)):
        got = np.concatenate([dot for _, dot in retrieval.products(left, right, cells, wide)])
        np.testing.assert_allclose(got, sides[0] @ sides[1].T, atol=1e-12)
    score = np.round(rng.random((40, 700)), 2)  # many ties
    row, column, value = retrieval.best_cells(score, 5)
    by_hand = [(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(700), -score[i]))[:5]]
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == by_hand and np.allclose(value / 1e6, score[row, column])


def test_plain_structured_search_counts_all_keys(spark):
    left, right = texts(spark, "q", [(1, "12 nation 3 red 7"), (2, "nation 4")]), texts(spark, "c", [(1, "12 nation 3"), (2, "nation 9"), (3, "nation red 7"), (4, "sea")])
    found = retrieval.structured_top_k(left, right, 25, "plain")
    assert sorted((r.q_id, r.c_id, r.score, r.tokens, r.numbers) for r in found.collect()) == [
        ("q1", "c1", 10.0, 1, 2), ("q1", "c2", 1.0, 1, 0), ("q1", "c3", 7.5, 2, 1), ("q2", "c1", 1.0, 1, 0), ("q2", "c2", 1.0, 1, 0), ("q2", "c3", 1.0, 1, 0),
    ]
    assert "kind" not in found._jdf.queryExecution().executedPlan().toString()  # no join on keys


def test_ratios_of_many_pairs(monkeypatch):
    """All pairs at once give what each gives alone."""
    import random

    import numpy as np
    import pandas as pd

    from matchloom.functions import fuzzy

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé 1स") for _ in range(rng.choice((0, 1, 3, 9, 30, 63, 64, 65, 90))))
    few = ["", " ", "a", "a a", "b a", "star star inc", "inc star", "x" * 64, "x" * 65, "\ud800b"] + [word() for _ in range(60)]
    rows = pd.DataFrame([(a, b) for a in few for b in few], columns=["n_a", "n_b"])
    columns = {"r": ("ratio", "n"), "o": ("sort", "n"), "s": ("set", "n")}
    got = fuzzy.ratio_struct(columns).func(rows)
    for name, function in (("r", fuzzy.plain_ratio), ("o", fuzzy.plain_token_sort), ("s", fuzzy.plain_token_set)):
        assert got[name].tolist() == [function(a, b) / 100 for a, b in zip(rows.n_a, rows.n_b, strict=True)]
    assert fuzzy.ratio_struct(columns).func(rows[:0]).shape == (0, 3)
    rows = pd.DataFrame({f"n_{s}": [f"{s} number {rng.randrange(10**9)} in a street" for _ in range(10000)] for s in "ab"})
    alone = [fuzzy.plain_ratio(a, b) / 100 for a, b in zip(rows.n_a, rows.n_b, strict=True)]
    monkeypatch.setattr(fuzzy, "lcs", None)  # no pair of short strings is computed alone
    assert np.array_equal(fuzzy.ratio_struct({"r": ("ratio", "n")}).func(rows).r, alone)


def test_thresholds_repeat_no_pair(spark):
    """Pairs are counted once for all thresholds: none is copied for each of them."""
    entities = spark.createDataFrame([("a",), ("b",)], "q_id string")
    truth = spark.createDataFrame([("a", "1")], "q_id string, c_id string")
    scored = spark.createDataFrame([("a", "1", 0.5), ("a", "2", None), ("b", "1", float("nan"))], "q_id string, c_id string, probability double")
    rows = E.entity_scores(entities, truth, scored, [0.9, 0.5, 0.5])
    assert sorted((r.threshold, r.tp, r.fp, r.fn) for r in rows.collect()) == [(0.5, 1, 1, 0), (0.9, 0, 1, 1)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "probability" not in plan[: plan.index("Generate")]  # what is repeated are entities, after the pairs are added up
    assert plan.count("Generate") == 1


def test_grams_of_long_texts_are_laid_out_in_parts():
    import tracemalloc

    import numpy as np

    texts = [" ".join(f"w{(i * j) % 40}" for j in range(2000)) for i in range(1, 300)] + ["", "a lone end"]
    whole, parts = retrieval.Grams(3, 4).counted(texts, 1 << 40), retrieval.Grams(3, 4).counted(texts, 1000)
    for one, other in ((whole.row, parts.row), (whole.gram, parts.gram), (whole.w, parts.w)):
        assert np.array_equal(one, other)
    tracemalloc.start()
    retrieval.Grams(3, 4).rows(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # all grams at once: 70 MB


def test_staged_channels_are_those_of_both_ways(spark, monkeypatch):
    from matchloom.plans import queries

    left, right = tables.sides(spark, SF)
    times = Counter()
    for name in ("routed_top_k", "structured_top_k"):
        monkeypatch.setattr(retrieval, name, lambda *a, f=getattr(retrieval, name), name=name, **b: times.update([name]) or f(*a, **b))
    plain, hybrid = blockers.staged(left, right)
    assert times == {"routed_top_k": 2, "structured_top_k": 1}
    rows = lambda table: sorted(map(tuple, table.select(sorted(table.columns)).collect()))
    assert rows(plain) == rows(queries.merged(spark, SF)) and rows(hybrid) == rows(blockers.hybrid(left, right))
    # The query takes its candidates from there: no search is run a second time for the lists.
    times.clear()
    monkeypatch.setattr(linkage, "fit", lambda *_: (None, None, None, None))
    monkeypatch.setattr(linkage, "decided", lambda *_: None)
    queries.inference(spark, SF)
    assert times == {"routed_top_k": 2, "structured_top_k": 1}


def test_features_move_a_record_once_a_block(spark, both):
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", i * j) for i in range(1, 5) for j in range(1, 5)], "q_id string, c_id string, label int")
    plan = features.pair_features(pairs, *both)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Pairs and both registries are dealt by one key; no exchange lies between the joins, where a pair has its records.
    assert len(moved) == 3 and all("(__cell#" in line and "_id#" not in line.split("Exchange")[1] for line in moved)
    rows = lambda table: sorted(map(tuple, table.select("q_id", "c_id", "q", "c", "label").collect()))
    small = rows(features.joined(pairs, *both, block=2))
    assert len(small) == 16 and small == rows(features.joined(pairs, *both))
    known = {r.q_id: r.q for r in features.prepared(both[0], "q").collect()}
    assert all(known[q_id] == q for q_id, _, q, _, _ in small)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_training_writes_each_registry_once(spark, monkeypatch):
    from matchloom.plans import queries

    times = []
    monkeypatch.setattr(queries, "sides", lambda *a, f=queries.sides: times.append(1) or f(*a))
    for name in ("training_table", "pair_features_all", "pair_features_plain"):
        queries.QUERIES[name](spark, SF)
        assert len(times) == 1, name
        times.clear()


def test_training_and_lists_share_their_features(spark, monkeypatch):
    """What training and lists take from the features of all pairs is what either had of its own; a pair's features are computed once."""
    from matchloom.plans import queries
    from matchloom.sources.io import stored

    left, right = tables.sides(spark, SF)
    links = tables.truth(spark, SF)
    every = stored(linkage.featured(blockers.joint(left, right), links, left, right))
    rows = lambda table: sorted(map(tuple, table.collect()))
    alone = queries.trained_on(queries.merged(spark, SF, (left, right)), links, left, right)
    training = blockers.without_reranking(every.where("kept")).drop("kept")
    assert features.feature_names(training) == features.feature_names(alone)
    assert rows(training.select(alone.columns)) == rows(alone)
    alone = features.pair_features(blockers.hybrid(left, right), left, right)
    assert rows(blockers.with_reranking(every).select(alone.columns)) == rows(alone)

    times, said = [], []
    monkeypatch.setattr(features, "joined", lambda *a, f=features.joined: times.append(1) or f(*a))
    monkeypatch.setattr(linkage, "decided", lambda *a, f=linkage.decided: said.append(a) or f(*a))
    monkeypatch.setattr(learning, "train", lambda *a, f=learning.train: f(*a, rounds=2, depth=3))
    lists = rows(queries.inference(spark, SF))
    assert len(times) == 1
    model, names, threshold, entities, pairs = said[0]
    scored = stored(learning.scored(model, pairs, names).select("q_id", "c_id", "probability"))
    old = linkage.id_lists(entities.select(F.col("entity_id").alias("q_id")), scored.select("q_id", "c_id"), scored.where(F.col("probability") >= threshold).select("q_id", "c_id"))
    assert lists == rows(old.select("source1_entity_id", "candidate_entity_ids", "matched_entity_ids"))


def test_reranking_takes_ratios_of_many_pairs_at_once(monkeypatch):
    import pandas as pd

    from matchloom.functions import fuzzy

    names = ["", "a", "acme paper", "customer 000000017", "supplier 000000071", "acme paper works"]
    rows = pd.DataFrame([(a, b, b, a) for a in names for b in names], columns=["latin_a", "latin_b", "name_a", "name_b"])
    alone = [fuzzy.plain_ratio(a, b) for a, b in zip(rows.latin_a, rows.latin_b, strict=True)]
    monkeypatch.setattr(fuzzy, "lcs", None)
    got = retrieval.name_ratios.func(rows)
    assert got.latin.tolist() == got.name.tolist() == alone  # percents, to the last digit


def test_registries_are_normalized_by_all_tasks(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(tables, "registry", lambda rows, f=tables.registry: parts.append(rows.rdd.getNumPartitions()) or f(rows))
    tables.sides(spark, SF)
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2
