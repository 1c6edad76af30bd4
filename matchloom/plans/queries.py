"""Registered queries, one or more per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import lexical_similarity, ratio, token_set_ratio, token_sort_ratio
from ..functions.translit import transliterate
from ..operators import evaluation as E
from ..operators import blockers, features, learning, relational, retrieval
from ..sources import io
from . import linkage
from . import oracle as O
from .tables import customers, sides, suppliers, table, truth, truth_lists

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def joined_text(column) -> F.Column:
    return F.array_join(column, " ")


# ---------------------------------------------------------------- text functions


@query(f"select doc_id, {O.norm('text')} as norm from documents")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query(f"select doc_id, {O.norm('text')} as norm from documents")  # these texts have no compatibility forms; tests hold the function against Python
def text_normalize_exact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_exact("text").alias("norm"))


@query(
    f"""with d as materialized (select doc_id, {O.norm("text")} n from documents)
select doc_id, len({O.tokens("n")})::bigint n_tokens, len({O.token_set("n")})::bigint n_distinct, len({O.meaningful("n")})::bigint n_meaningful,
 array_to_string({O.numbers("n")}, ' ') numbers, length({O.bare("n")})::bigint bare_length,
 len({O.address_tokens("n")})::bigint n_address_tokens, regexp_matches(n, '[^\\x00-\\x7F]') non_ascii from d"""
)
def text_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("n"))
    size = lambda c: F.size(c).cast("bigint")
    return d.select(
        "doc_id", size(T.tokens("n")).alias("n_tokens"), size(T.token_set("n")).alias("n_distinct"), size(T.meaningful_tokens("n")).alias("n_meaningful"),
        joined_text(T.ordered_numbers("n")).alias("numbers"),
        F.length(T.without_legal_forms("n")).cast("bigint").alias("bare_length"), size(T.address_tokens("n")).alias("n_address_tokens"),
        T.contains_non_ascii("n").alias("non_ascii"),
    )


@query(f"with {O.SIDES} select id, unnest({O.ngrams('name')}) gram from s1 union all select id, unnest({O.ngrams('address')}) from s2")
def character_grams(spark, sf):
    left, right = sides(spark, sf)
    return left.select("id", F.explode(T.char_ngrams("name")).alias("gram")).union(right.select("id", F.explode(T.char_ngrams("address"))))


@query(
    f"""with {O.SIDES}, {O.keys("nk", "s1", "name")}, {O.keys("ak", "s1", "address")}
select id, country, 'name' kind, key from nk union all select id, country, 'address', key from ak"""
)
def routing_keys(spark, sf):
    left, _ = sides(spark, sf)
    parts = [retrieval.keys(left, kind).select("id", "country", F.lit(kind).alias("kind"), "key") for kind in ("name", "address")]
    return parts[0].union(parts[1])


@query(f"select 'S1-' || doc_id id, {O.fraction(chr(39) + 'S1-' + chr(39) + ' || doc_id')} fraction, case when {O.fraction(chr(39) + 'S1-' + chr(39) + ' || doc_id')} < 0.2 then 'val' else 'train' end split from documents")
def hash_split(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat(F.lit("S1-"), "doc_id").alias("id"))
    return rows.select("id", T.hash_fraction("id").alias("fraction"), T.split_name("id").alias("split"))


@query("select n_nationkey, translate(n_name || '/ ' || r_name, '/ ', '__') path from nation join region on n_regionkey = r_regionkey")
def path_names(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", T.path_name(F.concat("n_name", F.lit("/ "), "r_name")).alias("path"))


@query()
def text_transliterate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", transliterate("text").alias("latin"))


# ---------------------------------------------------------------- relational glue


@query(f"with {O.SOURCES}, {O.TRUTH}, {O.LISTS} select source1_entity_id, unnest(string_split(matched_entity_ids, ',')) matched_entity_id from lists where matched_entity_ids <> ''")
def truth_explode(spark, sf):
    return relational.explode_ids(truth_lists(spark, sf), "source1_entity_id", "matched_entity_ids", "matched_entity_id")


@query(f"with {O.SOURCES}, {O.TRUTH}, {O.LISTS} select * from lists")
def truth_collapse(spark, sf):
    return truth_lists(spark, sf)


BUCKET = "case when n >= 5 then '5+' else n::varchar end"
COUNTS = f"counts as (select c.entity_id id, country, count(c_id) n from customers c left join truth on q_id = c.entity_id group by all)"


@query(f"with {O.SOURCES}, {O.TRUTH}, {COUNTS} select id, country, n num_matches, {BUCKET} match_bucket, country || '_' || {BUCKET} stratum, case when {O.fraction('id')} < 0.2 then 'val' else 'train' end split from counts")
def split_table(spark, sf):
    per = customers(spark, sf).select(F.col("entity_id").alias("id"), "country").join(truth(spark, sf).groupBy(F.col("q_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").fillna({"n": 0})
    bucket = T.match_bucket(F.col("n"))
    return per.select("id", "country", F.col("n").alias("num_matches"), bucket.alias("match_bucket"), F.concat_ws("_", "country", bucket).alias("stratum"), T.split_name("id").alias("split"))


@query(
    f"""with {O.SOURCES}, {O.TRUTH}, {COUNTS}, t as (select country, {BUCKET} b from counts),
m as (select country, b from t union all select 'All', b from t)
select country, count(*) filter (b = '0') "0", count(*) filter (b = '1') "1", count(*) filter (b = '2') "2", count(*) filter (b = '3') "3",
 count(*) filter (b = '4') "4", count(*) filter (b = '5+') "5+", count(*) "All" from m group by country"""
)
def split_crosstab(spark, sf):
    return relational.crosstab(split_table(spark, sf), "country", "match_bucket", ["0", "1", "2", "3", "4", "5+"])


@query(
    """with x as (select 'c_name' as "column", c_name v from customer union all select 'c_mktsegment', c_mktsegment from customer union all select 'c_nationkey', c_nationkey::varchar from customer)
select "column", count(*) n, count(*) filter (v is null) nulls, count(*) filter (v = '') "empty", count(distinct v) distinct_values, count(v) - count(distinct v) repeats from x group by 1"""
)
def source_profile(spark, sf):
    return relational.profile(table(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])


@query(
    """select lang, count(*) n, round(avg(length(text)), 6) mean, min(length(text))::double least, max(length(text))::double largest,
 round(quantile_cont(length(text), 0.25), 6) p25, round(quantile_cont(length(text), 0.5), 6) p50, round(quantile_cont(length(text), 0.95), 6) p95 from documents group by 1"""
)
def text_lengths(spark, sf):
    return relational.describe(table(spark, sf, "documents"), F.length("text"), ["lang"], {"p25": 0.25, "p50": 0.5, "p95": 0.95})


@query("select country, n, round(100.0 * n / sum(n) over (), 6) percent from (select lang country, count(*) n from documents group by 1)")
def country_shares(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("country")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"]
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.lit(total), 6))


@query("select distinct trim(lang) country from documents where trim(lang) <> ''")
def countries(spark, sf):
    return table(spark, sf, "documents").select(F.trim("lang").alias("country")).where("country <> ''").distinct()


@query(
    f"""with {O.SOURCES}, {O.TRUTH}, t as (select q_id left_id, c_id right_id from truth union all select 'S1--1', 'S2-0' union all select 'S1-0', 'S2--1' union all select 'S1-0', 'S2--1')
select 'unknown left' problem, count(*) links from t where left_id not in (select entity_id from customers)
union all select 'unknown right', count(*) from t where right_id not in (select entity_id from suppliers)
union all select 'repeated', count(*) from (select 1 from t group by left_id, right_id having count(*) > 1)"""
)
def truth_validation(spark, sf):
    wrong = spark.createDataFrame([("S1--1", "S2-0"), ("S1-0", "S2--1"), ("S1-0", "S2--1")], "left_id string, right_id string")
    links = truth(spark, sf).select(F.col("q_id").alias("left_id"), F.col("c_id").alias("right_id")).union(wrong)
    return relational.truth_problems(links, customers(spark, sf).select(F.col("entity_id").alias("left_id")), suppliers(spark, sf).select(F.col("entity_id").alias("right_id")))


@query(
    f"""with {O.SOURCES}, {O.TRUTH}, p as (select q_id, count(*) n from truth group by 1)
select (select count(*) from customers) entities, (select count(*) from p) matched, sum(n)::bigint links, max(n) most, (select count(distinct c_id) from truth) targets from p"""
)
def truth_summary(spark, sf):
    links = truth(spark, sf)
    per = links.groupBy("q_id").agg(F.count("*").alias("n"))
    total = per.agg(F.count("*").alias("matched"), F.sum("n").alias("links"), F.max("n").alias("most"))
    n, targets = customers(spark, sf).count(), links.select("c_id").distinct().count()
    return total.select(F.lit(n).cast("bigint").alias("entities"), "matched", "links", "most", F.lit(targets).cast("bigint").alias("targets"))


@query(
    f"""with {O.SOURCES}, {O.TRUTH}, l as (select q_id, case when right(c_id, 1) in ('1', '3', '5', '7', '9') then 'S3' else 'S2' end s from truth),
p as (select c.entity_id, country, count(s) links, coalesce(string_agg(distinct s, '+' order by s), 'none') sources from customers c left join l on q_id = c.entity_id group by all)
select country, sources, count(*) entities, sum(links)::bigint links, max(links) most from p group by all"""
)
def truth_by_source(spark, sf):
    """Suppliers with odd numbers stand for a third source."""
    third = F.when(F.right("c_id", F.lit(1)).isin("1", "3", "5", "7", "9"), F.replace("c_id", F.lit("S2-"), F.lit("S3-"))).otherwise(F.col("c_id"))
    return E.truth_by_source(customers(spark, sf).select(F.col("entity_id").alias("q_id"), "country"), truth(spark, sf).select("q_id", third.alias("c_id")))


@query(
    f"""with {O.SIDES}, {O.TRUTH} select count(*) positives, count(*) filter (a.name = b.name and a.name <> '') name_equal, count(*) filter (a.address = b.address and a.address <> '') address_equal,
 count(*) filter (a.country = b.country) country_equal, count(*) filter ((a.name = b.name and a.name <> '') or (a.address = b.address and a.address <> '')) either_equal,
 count(*) filter (a.name = b.name and a.name <> '' and a.address = b.address and a.address <> '') both_equal, count(*) filter (a.address = '') left_missing, count(*) filter (b.address = '') right_missing
 from truth join s1 a on a.id = q_id join s2 b on b.id = c_id"""
)
def normalized_exact_counts(spark, sf):
    left, right = sides(spark, sf)
    left.createOrReplaceTempView("registry_left")
    right.createOrReplaceTempView("registry_right")
    truth(spark, sf).createOrReplaceTempView("registry_truth")
    return spark.sql(
        """select count(*) positives, count_if(a.name = b.name and a.name <> '') name_equal, count_if(a.address = b.address and a.address <> '') address_equal,
        count_if(a.country = b.country) country_equal, count_if((a.name = b.name and a.name <> '') or (a.address = b.address and a.address <> '')) either_equal,
        count_if(a.name = b.name and a.name <> '' and a.address = b.address and a.address <> '') both_equal, count_if(a.address = '') left_missing, count_if(b.address = '') right_missing
        from registry_truth join registry_left a on a.id = q_id join registry_right b on b.id = c_id"""
    )


@query("select p_partkey, p_name from part order by md5('42:' || p_partkey), p_partkey limit 50")
def sample_rows(spark, sf):
    return relational.sample(table(spark, sf, "part"), "p_partkey", 50).select("p_partkey", "p_name")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 10")
def sorted_head(spark, sf):
    return table(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query(
    """select o_orderkey, o_custkey, coalesce(c_name, '') c_name, coalesce(c_mktsegment, '') c_mktsegment from orders left join customer on o_custkey = c_custkey
where o_orderpriority like '1-%' and o_custkey in (select c_custkey from customer where c_acctbal > 0)"""
)
def lookup_join(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1-"))
    kept = orders.join(c.where("c_acctbal > 0"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")
    return relational.lookup(relational.lookup(kept, c, "o_custkey", "c_name"), c, "o_custkey", "c_mktsegment").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("select d.doc_id, lang, quality, toxic from documents d join labels l on d.doc_id = l.doc_id")
def one_to_one_join(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")
    return relational.join_one_to_one(docs, labels, ["doc_id"]).select("doc_id", "lang", "quality", "toxic")


@query("""select event_id, event_type, coalesce(try_cast(regexp_extract(props, '"k": ?(-?[0-9a-z]+)', 1) as integer), 0)::bigint k from events""")
def coerced_numbers(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", "event_type", F.coalesce(k, F.lit(0)).cast("bigint").alias("k"))


# ---------------------------------------------------------------- sources and sinks


@query(f"with {O.SOURCES} select * from customers")
def delimited_registry(spark, sf):
    """A registry as tab-separated text, written and read again."""
    path = io.shared_folder(spark)
    io.write_delimited(customers(spark, sf), path)
    return io.read_registry(spark, path)


@query("select p_partkey::varchar p_partkey, p_name, coalesce(p_type, '') p_type from part")
def comma_separated_parts(spark, sf):
    path = io.shared_folder(spark)
    io.write_delimited(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), path, sep=",")
    return io.read_delimited(spark, path, ("p_partkey", "p_name", "p_type"), sep=",")


@query(f"with {O.SOURCES}, {O.TRUTH}, {O.LISTS} select * from lists")
def delimited_truth(spark, sf):
    path = io.shared_folder(spark)
    io.write_lists(truth_lists(spark, sf), "source1_entity_id", "matched_entity_ids", path)
    return io.read_truth(spark, path)


@query("select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderpriority like '1-%' group by all")
def globbed_parts(spark, sf):
    """Orders in folders by status and priority; a pattern reads one priority's folders of every status."""
    path = io.shared_folder(spark)
    io.write_parquet(table(spark, sf, "orders"), path, ("o_orderstatus", "o_orderpriority"))
    rows = io.read_parts(spark, f"{path}/*/o_orderpriority=1-*", path)
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def unfinished_keys(spark, sf):
    """Customers of all orders that a first run, over finished orders only, has not written."""
    orders, path = table(spark, sf, "orders"), io.shared_folder(spark)
    io.write_parquet(orders.where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice"), path)
    return io.unfinished(orders.select("o_custkey").distinct(), spark, path, ["o_custkey"])


@query("select o_orderstatus, count(*) n, round(avg(o_totalprice), 4) mean, null::varchar note from orders group by 1")
def json_statistics(spark, sf):
    """Statistics written as JSON and read with a field that is not there."""
    path = io.shared_folder(spark)
    io.write_json(table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")), path)
    return io.read_json(spark, path, "o_orderstatus string, n bigint, mean double, note string")


# ---------------------------------------------------------------- retrieval


def found(rows: DataFrame) -> DataFrame:
    return rows.select("q_id", "c_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"with {O.SIDES}, {O.weights('q', 's1', 'name', 3, 4)}, {O.weights('c', 's2', 'name', 3, 4)}, {O.cosine('s', 'q', 'c')}, {O.ranked('r', 's', 20)} select * from r")
def name_top_k(spark, sf):
    return found(retrieval.cosine_top_k(*sides(spark, sf), "name", retrieval.NAME_GRAMS, 20))


@query(f"with {O.SIDES}, {O.weights('q', 's1', 'address', 3, 5)}, {O.weights('c', 's2', 'address', 3, 5)}, {O.cosine('s', 'q', 'c')}, {O.ranked('r', 's', 20)} select * from r")
def address_top_k(spark, sf):
    return found(retrieval.cosine_top_k(*sides(spark, sf), "address", retrieval.ADDRESS_GRAMS, 20))


def tfidf_sql() -> str:
    grams = O.grams("address", 3, 4)
    part = lambda n, rows: (
        f"{n}_g as (select id, country, unnest({grams}) gram from {rows}), {n}_c as (select id, country, gram, count(*) n from {n}_g group by all),\n"
        f"{n}_v as (select id, country, c.gram, n * idf v from {n}_c c join idf i on i.gram = c.gram), {n} as materialized (select id, country, gram, v / sqrt(sum(v * v) over (partition by id)) w from {n}_v)"
    )
    return f"""with {O.SIDES}, idf as (select gram, ln((1.0 + (select count(*) from s2)) / (1.0 + count(*))) + 1 idf from (select distinct id, unnest({grams}) gram from s2) group by gram having count(*) >= 5),
{part("q", "s1")}, {part("c", "s2")}, {O.cosine("s", "q", "c")}, {O.ranked("r", "s", 10)} select * from r"""


@query(tfidf_sql())
def tfidf_top_k(spark, sf):
    return found(retrieval.tfidf_top_k(*sides(spark, sf), "address", 10))


@query()
def transliterated_top_k(spark, sf):
    """Names are the texts of conversation turns, all of one country; queries are the user's, targets the others'."""
    turns = table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    rows = turns.select("id", F.lit("").alias("country"), F.col("text").alias("raw_name"), "role")
    return found(retrieval.transliterated_top_k(rows.where("role = 'user'"), rows.where("role <> 'user'"), 20))


@query(f"with {O.SIDES}, {O.routed('r', 'name', 3, 4)} select q_id, c_id, score, rank from r")
def routed_name_top_k(spark, sf):
    return found(retrieval.routed_top_k(*sides(spark, sf), "name", retrieval.NAME_GRAMS))


@query(f"with {O.SIDES}, {O.routed('r', 'address', 3, 5)} select q_id, c_id, score, rank from r")
def routed_address_top_k(spark, sf):
    return found(retrieval.routed_top_k(*sides(spark, sf), "address", retrieval.ADDRESS_GRAMS))


@query(
    f"""with {O.SIDES} select q_id, c_id, max(n)::int by_name, max(a)::int by_address from (
select s1.id q_id, s2.id c_id, 1 n, 0 a from s1 join s2 on s1.country = s2.country and s1.name = s2.name and s1.name <> ''
union all select s1.id, s2.id, 0, 1 from s1 join s2 on s1.country = s2.country and s1.address = s2.address and s1.address <> '') group by all"""
)
def exact_pairs(spark, sf):
    return retrieval.exact_pairs(*sides(spark, sf))


@query("select a.p_partkey q_id, b.s_suppkey c_id from part a join supplier b on a.p_partkey = b.s_suppkey")
def exact_key_pairs(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("country"), F.col("p_partkey").cast("string").alias("name"), F.lit("").alias("address"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit("").alias("country"), F.col("s_suppkey").cast("string").alias("name"), F.lit("").alias("address"))
    return retrieval.exact_pairs(p, s).select(F.col("q_id").cast("bigint").alias("q_id"), F.col("c_id").cast("bigint").alias("c_id"))


@query(f"""with {O.SIDES}, {O.postings("p", "s2")} select country, kind, "key", count(distinct id) df from p group by all""")
def posting_frequencies(spark, sf):
    return retrieval.frequencies(retrieval.postings(sides(spark, sf)[1]))


def structured_query(name: str, form: str, k: int, **options) -> None:
    def run(spark, sf):
        rows = retrieval.structured_top_k(*sides(spark, sf), k, form, **options)
        return rows.select("q_id", "c_id", "score", "tokens", "numbers", F.col("rank").cast("bigint").alias("rank"))

    run.__name__ = name
    query(f"with {O.SIDES}, {O.structured('r', k, form, **options)} select q_id, c_id, score, tokens, numbers, rank from r")(run)


structured_query("structured_top_k", "all", 100)
structured_query("structured_top_k_capped", "all", 100, token_df=15, number_df=5)
structured_query("structured_top_k_selective", "selective", 100, token_df=15, number_df=5, stop=T.STOP_FIRST, least=1)
structured_query("structured_top_k_plain", "plain", 25, stop=T.STOP_FOLD, least=1)
structured_query("structured_top_k_queries", "queries", 20, stop=T.STOP_SCRIPT, least=3)


def reranked(spark, sf, form: str) -> DataFrame:
    left, right = sides(spark, sf)
    return found(retrieval.rerank(retrieval.structured_top_k(left, right, 100), left, right, 25, form))


def rerank_query(name: str, form: str) -> None:
    def run(spark, sf):
        return reranked(spark, sf, form)

    run.__name__ = name
    query(f"with {O.SIDES}, {O.structured('st', 100)}, {O.reranked('r', 'st', 25, form)} select * from r")(run)


rerank_query("structured_rerank", "max")
rerank_query("structured_rerank_lexical", "lexical")
rerank_query("structured_rerank_range", "range")


MERGED = f"""{O.SIDES}, {O.TRUTH}, {O.routed("nm", "name", 3, 4)}, {O.routed("ad", "address", 3, 5)}, {O.structured("st", 25)},
merged as materialized (select q_id, c_id, max(fn)::int from_name_blocker, max(fa)::int from_address_blocker, max(fs)::int from_structured_blocker, 0 from_embedding_blocker,
 max(sn)::double name_retrieval_score, max(sa)::double address_retrieval_score, max(ss)::double structured_retrieval_score, 0 embedding_rank from (
 select q_id, c_id, 1 fn, 0 fa, 0 fs, score sn, 0.0 sa, 0.0 ss from nm union all select q_id, c_id, 0, 1, 0, 0, score, 0 from ad union all select q_id, c_id, 0, 0, 1, 0, 0, score from st) group by q_id, c_id)"""


def merged(spark, sf, both: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Three channels without the reranking, so that SQL can follow; ``both`` are the registries, if they are written already."""
    left, right = both or sides(spark, sf)
    return retrieval.merge_channels(
        {
            "name": retrieval.routed_top_k(left, right, "name", retrieval.NAME_GRAMS),
            "address": retrieval.routed_top_k(left, right, "address", retrieval.ADDRESS_GRAMS),
            "structured": retrieval.structured_top_k(left, right, 25),
        }
    )


@query(f"with {MERGED} select * from merged")
def merged_candidates(spark, sf):
    return merged(spark, sf)


FULL = f"""{O.SIDES}, {O.weights("nq", "s1", "name", 3, 4)}, {O.weights("nc", "s2", "name", 3, 4)}, {O.cosine("ns", "nq", "nc")}, {O.ranked("nm", "ns", 20)},
{O.weights("aq", "s1", "address", 3, 5)}, {O.weights("ac", "s2", "address", 3, 5)}, {O.cosine("as_", "aq", "ac")}, {O.ranked("ad", "as_", 20)}"""


def channels_sql(structured: str) -> str:
    return f"""select q_id, c_id, max(fn)::int from_name_blocker, max(fa)::int from_address_blocker, max(fs)::int from_structured_blocker, 0 from_embedding_blocker,
 max(sn)::double name_retrieval_score, max(sa)::double address_retrieval_score, max(ss)::double structured_retrieval_score, 0 embedding_rank from (
 select q_id, c_id, 1 fn, 0 fa, 0 fs, score sn, 0.0 sa, 0.0 ss from nm union all select q_id, c_id, 0, 1, 0, 0, score, 0 from ad{structured}) group by q_id, c_id"""


@query(f"with {FULL} {channels_sql('')}")
def full_text_candidates(spark, sf):
    return blockers.full_text(*sides(spark, sf))


@query(f"with {FULL}, {O.structured('st', 25, 'plain', stop=T.STOP_FOLD, least=1)} {channels_sql(' union all select q_id, c_id, 0, 0, 1, 0, 0, score from st')}")
def folded_candidates(spark, sf):
    return blockers.folded(*sides(spark, sf))


PLACE = " union all select q_id, c_id, 0, 0, 1, 0, 0, score from pl"


@query(f"with {FULL}, {O.structured('st', 100, 'selective', stop=T.STOP_FIRST, least=1)}, {O.reranked('pl', 'st', 25, 'lexical')} {channels_sql(PLACE)}")
def country_candidates(spark, sf):
    return blockers.country(*sides(spark, sf))


ROUTED = f"""{O.SIDES}, {O.routed("nm", "name", 3, 4)}, {O.routed("ad", "address", 3, 5)}"""


@query(f"with {ROUTED}, {O.structured('st', 100)}, {O.reranked('pl', 'st', 25, 'max')} {channels_sql(PLACE)}")
def hybrid_candidates(spark, sf):
    return blockers.hybrid(*sides(spark, sf))


@query(f"with {ROUTED} {channels_sql('')}")
def stored_index_candidates(spark, sf):
    """The routed searches on an index that is written, by country, and read again."""
    left, right = sides(spark, sf)
    path = io.shared_folder(spark)
    blockers.Index.of(right).write(path)
    return blockers.routed(left, blockers.Index.read(spark, path))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(
    """with s as (select a.vec_id q_id, b.vec_id c_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 5) score from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select q_id, c_id, score, row_number() over (partition by q_id order by score desc, c_id) rank from s qualify rank <= 10"""
)
def embedding_top_k(spark, sf):
    return found(retrieval.embedding_top_k(vectors(spark, sf), vectors(spark, sf), 10))


@query()
def embedding_top_k_approx(spark, sf):
    return found(retrieval.embedding_top_k_approx(vectors(spark, sf), 10))


# ---------------------------------------------------------------- features


FEATURE_SQL = f"""f as materialized (select q_id, c_id, a.name na, b.name nb, a.address aa, b.address ab, {O.token_set("a.name")} ta, {O.token_set("b.name")} tb,
 {O.meaningful("a.name")} ma, {O.meaningful("b.name")} mb, {O.ngrams("a.name")} ga, {O.ngrams("b.name")} gb, {O.token_set("a.address")} pa, {O.token_set("b.address")} pb,
 {O.numbers("a.address")} oa, {O.numbers("b.address")} ob from merged join s1 a on a.id = q_id join s2 b on b.id = c_id),
g as (select *, list_distinct(oa) xa, list_distinct(ob) xb, {O.overlap("ta", "tb")} sh, {O.overlap("ma", "mb")} sm, {O.overlap("oa", "ob")} sn from f)"""


def per(shared: str, base: str) -> str:
    return f"case when len({base}) = 0 then 0.0 else {shared}::double / len({base}) end"


def length_ratio(a: str, b: str) -> str:
    return f"case when length({a}) = 0 and length({b}) = 0 then 1.0 when length({a}) = 0 or length({b}) = 0 then 0.0 else least(length({a}), length({b}))::double / greatest(length({a}), length({b})) end"


PLAIN = f"""(na = nb and na <> '')::int name_exact, {O.jaccard("ta", "tb")} name_token_jaccard, {length_ratio("na", "nb")} name_length_ratio,
 len(ta)::int name_token_count_s1, len(tb)::int name_token_count_s2, sh::int shared_name_token_count, {per("sh", "ta")} s1_name_containment, {per("sh", "tb")} s2_name_containment,
 len(ma)::int meaningful_name_token_count_s1, len(mb)::int meaningful_name_token_count_s2, sm::int shared_meaningful_name_tokens, (len(ma) - sm)::int extra_meaningful_tokens_s1,
 (len(mb) - sm)::int extra_meaningful_tokens_s2, {per("sm", "ma")} meaningful_s1_containment, {per("sm", "mb")} meaningful_s2_containment, {O.jaccard("ga", "gb")} name_char_3gram_jaccard,
 (aa = ab and aa <> '')::int address_exact, {O.jaccard("pa", "pb")} address_token_jaccard, {length_ratio("aa", "ab")} address_length_ratio, (aa = '')::int s1_address_missing, (ab = '')::int s2_address_missing,
 sn::int shared_number_count, {O.jaccard("xa", "xb")} number_jaccard, (len(xa) > 0 and len(xb) > 0 and sn = len(xa) and sn = len(xb))::int number_exact_set,
 (len(xa) > 0 and len(xb) > 0)::int both_have_numbers, (len(xa) > 0 and len(xb) > 0 and sn = 0)::int number_conflict, (len(oa) > 0 and oa = ob)::int ordered_number_exact,
 (len(oa) > 0 and len(ob) > 0 and oa[1] = ob[1])::int first_number_match, (len(oa) > 0 and len(ob) > 0 and oa[1] <> ob[1])::int first_number_conflict"""


@query(f"with {MERGED}, {FEATURE_SQL} select q_id, c_id, {PLAIN} from g")
def pair_features_plain(spark, sf):
    left, right = sides(spark, sf)
    columns = features.plain_features(F.col("q"), F.col("c"))
    return features.joined(merged(spark, sf, (left, right)).select("q_id", "c_id"), left, right).select("q_id", "c_id", *[v.alias(k) for k, v in columns.items()])


# Names are in ASCII here, so their spelling in Latin letters is the normalized name.
WITH_RATIOS = f"""b as materialized (select *, {O.bare("na")} ba, {O.bare("nb")} bb from g),
{O.ratios("rt", "select na a, nb b from b union all select ba, bb from b union all select aa, ab from b")},
every as materialized (select b.q_id, b.c_id, {PLAIN}, rn.ratio name_ratio, rn.sort name_token_sort, rn."set" name_token_set, rb.ratio legal_suffix_stripped_ratio, rb."set" legal_suffix_stripped_token_set,
 rn.ratio translit_name_ratio, rn.sort translit_name_token_sort, rn."set" translit_name_token_set, ra.ratio address_ratio, ra.sort address_token_sort, ra."set" address_token_set
 from b join rt rn on rn.a = na and rn.b = nb join rt rb on rb.a = ba and rb.b = bb join rt ra on ra.a = aa and ra.b = ab)"""
ORIGIN = "m.*, (from_name_blocker + from_address_blocker + from_structured_blocker + from_embedding_blocker)::int blocker_count"
COMBINED = """(address_token_jaccard >= 0.8 and name_ratio < 0.6)::int strong_address_weak_name, (name_token_set >= 0.9 and address_token_jaccard < 0.3)::int strong_name_weak_address,
 (address_token_jaccard >= 0.8 and number_jaccard >= 0.8)::int address_number_agreement, (address_token_set >= 0.9 and name_token_set < 0.6)::int high_address_low_name,
 (translit_name_ratio >= 0.8 and name_ratio < 0.5)::int translit_rescue, (translit_name_token_set >= 0.8 and address_token_set >= 0.8 and name_ratio < 0.6)::int translit_address_rescue,
 (address_token_jaccard >= 0.8 and number_jaccard >= 0.8 and name_token_set < 0.5)::int strong_address_number_name_conflict, (name_token_set >= 0.9 and number_conflict = 1)::int strong_name_number_conflict,
 address_token_jaccard * number_jaccard address_x_number, address_token_set * number_jaccard address_set_x_number, name_token_set * address_token_set name_x_address,
 name_token_jaccard * address_token_jaccard name_jaccard_x_address_jaccard, translit_name_token_set * address_token_set translit_x_address, translit_name_ratio * address_token_jaccard translit_ratio_x_address_jaccard,
 meaningful_s1_containment * meaningful_s2_containment * address_token_set meaningful_name_x_address, least(name_token_set, address_token_set) name_address_min, greatest(name_token_set, address_token_set) name_address_max,
 abs(name_token_set - address_token_set) name_address_abs_diff"""


@query(f"with {MERGED}, {FEATURE_SQL}, {WITH_RATIOS} select e.*, {ORIGIN.replace('m.*', 'm.* exclude (q_id, c_id)')}, {COMBINED} from every e join merged m on m.q_id = e.q_id and m.c_id = e.c_id")
def pair_features_all(spark, sf):
    both = sides(spark, sf)
    return features.interactions(features.pair_features(merged(spark, sf, both), *both))


@query()
def fuzzy_ratios(spark, sf):
    """Ratios of every conversation turn's normalized text and that of the turn numbered one less."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.normalize("text").alias("b"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("b").alias("a"))
    both = turns.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", ratio("a", "b").alias("ratio"), token_sort_ratio("a", "b").alias("token_sort"), token_set_ratio("a", "b").alias("token_set"), lexical_similarity("a", "b").alias("lexical"))


# ---------------------------------------------------------------- training and evaluation


LABELLED = "labelled as materialized (select m.*, (t.q_id is not null)::int as label from merged m left join truth t on t.q_id = m.q_id and t.c_id = m.c_id)"
HARD = "greatest(name_retrieval_score, address_retrieval_score, structured_retrieval_score) + 0.05 * (from_name_blocker + from_address_blocker + from_structured_blocker + from_embedding_blocker)"


@query(
    f"""with {MERGED}, {LABELLED}, h as (select *, round({HARD}, 6) hardness, case when {O.fraction("q_id")} < 0.2 then 'val' else 'train' end split from labelled),
r as (select *, row_number() over (partition by q_id, label order by hardness desc, c_id) nth from h)
select q_id, c_id, label, split, hardness from r where split = 'val' or label = 1 or nth <= 20"""
)
def mined_negatives(spark, sf):
    pairs = E.labelled(merged(spark, sf), truth(spark, sf)).withColumn("split", T.split_name("q_id"))
    return E.mined(pairs, 20).select("q_id", "c_id", "label", "split", "hardness")


def entities(spark, sf) -> DataFrame:
    return customers(spark, sf).select(F.col("entity_id").alias("q_id"))


@query(
    f"""with {O.SIDES}, {O.TRUTH}, {O.weights("q", "s1", "address", 3, 5)}, {O.weights("c", "s2", "address", 3, 5)}, {O.cosine("s", "q", "c")}, {O.ranked("r", "s", 20)},
ks as (select unnest([5, 10, 20, -1]) k), l as (select k, t.q_id, count(*) links, count(rank) filter (k < 0 or rank <= k) found from truth t cross join ks left join r on r.q_id = t.q_id and r.c_id = t.c_id group by all),
z as (select k, count(*) filter (k < 0 or rank <= k) n from r cross join ks group by k)
select l.k, sum(links)::bigint links, sum(found)::bigint found, round(sum(found) / sum(links), 6) recall, round(any_value(z.n) / (select count(*) from s1), 6) average_candidates,
 count(*) filter (found = links) "full", count(*) filter (found > 0 and found < links) "partial", count(*) filter (found = 0) "none" from l join z on z.k = l.k group by l.k"""
)
def recall_by_k(spark, sf):
    rows = retrieval.cosine_top_k(*sides(spark, sf), "address", retrieval.ADDRESS_GRAMS, 20)
    return E.recall(entities(spark, sf), truth(spark, sf), rows, (5, 10, 20))


@query(
    f"""with {MERGED}, {LABELLED}, h as (select *, {HARD} hardness, case when {O.fraction("q_id")} < 0.2 then 'val' else 'train' end split from labelled),
r as (select *, row_number() over (partition by q_id, label order by round(hardness, 6) desc, c_id) nth from h)
select country, r.split, count(*) candidates, count(*) filter (r.split = 'val' or label = 1 or nth <= 20) kept, sum(label)::bigint positives, count(distinct q_id) queries from r join s1 on s1.id = q_id group by all"""
)
def batch_statistics(spark, sf):
    left, _ = sides(spark, sf)
    pairs = E.labelled(merged(spark, sf), truth(spark, sf)).withColumn("split", T.split_name("q_id"))
    return E.batch_statistics(pairs.join(left.select(F.col("id").alias("q_id"), "country"), "q_id"), 20)


@query(
    f"""with {MERGED}, p as (select s1.id, count(c_id) n from s1 left join merged on q_id = s1.id group by 1)
select sum(n)::bigint candidates, round(avg(n), 6) mean, round(quantile_cont(n, 0.5), 6) p50, round(quantile_cont(n, 0.95), 6) p95, round(quantile_cont(n, 0.99), 6) p99, max(n) most, count(*) filter (n = 0) "without" from p"""
)
def candidate_counts(spark, sf):
    return E.candidate_counts(entities(spark, sf), merged(spark, sf))


NEAR = f"""{O.SIDES}, {O.TRUTH}, {O.weights("q", "s1", "address", 3, 5)}, {O.weights("c", "s2", "address", 3, 5)}, {O.cosine("s", "q", "c")}, {O.ranked("near", "s", 5)}"""


def missed(spark, sf) -> DataFrame:
    """Links that the five nearest addresses do not have."""
    return E.missed(truth(spark, sf), retrieval.cosine_top_k(*sides(spark, sf), "address", retrieval.ADDRESS_GRAMS, 5))


@query(f"with {NEAR} select q_id, c_id from truth except select q_id, c_id from near")
def missed_links(spark, sf):
    return missed(spark, sf)


@query(
    f"""with {MERGED}, {LABELLED}, c as (select *, from_name_blocker + from_address_blocker + from_structured_blocker n from labelled),
x as (select 'from_name_blocker' channel, label, n from c where from_name_blocker = 1 union all select 'from_address_blocker', label, n from c where from_address_blocker = 1 union all select 'from_structured_blocker', label, n from c where from_structured_blocker = 1)
select channel, count(*) pairs, sum(label)::bigint links, count(*) filter (label = 1 and n = 1) only_here from x group by 1"""
)
def channel_contributions(spark, sf):
    return E.contributions(truth(spark, sf), merged(spark, sf))


SCORED = "scored as materialized (select q_id, c_id, label, round((0.4 * name_retrieval_score + 0.4 * address_retrieval_score + 0.02 * structured_retrieval_score), 6) probability from labelled)"


def scored(spark, sf) -> DataFrame:
    """The candidates with a score in place of a model's probability."""
    p = 0.4 * F.col("name_retrieval_score") + 0.4 * F.col("address_retrieval_score") + 0.02 * F.col("structured_retrieval_score")
    return E.labelled(merged(spark, sf), truth(spark, sf)).select("q_id", "c_id", "label", F.round(p, 6).alias("probability"))


def f_half_sql(thresholds: list[float]) -> str:
    grid = "[" + ", ".join(f"{t}::double" for t in thresholds) + "]"
    return f"""with {MERGED}, {LABELLED}, {SCORED}, ts as (select unnest({grid}) threshold), {f_half_steps()}"""


def f_half_steps() -> str:
    return """k as (select s1.id q_id, count(t.c_id) links from s1 left join truth t on t.q_id = s1.id group by 1),
m as (select q_id, threshold, sum(label) tp, sum(1 - label) fp from scored join ts on probability >= threshold group by all),
e as (select threshold, k.q_id, links, coalesce(tp, 0) tp, coalesce(fp, 0) fp from k cross join ts left join m using (q_id, threshold)),
r as (select threshold, round(avg(case when 1.25 * tp + 0.25 * (links - tp) + fp = 0 then 1.0 else 1.25 * tp / (1.25 * tp + 0.25 * (links - tp) + fp) end), 6) f_half, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(links - tp)::bigint fn from e group by 1)"""


GRID = E.grid(0.05, 0.95, 0.025)


@query(f"{f_half_sql(GRID)} select * from r")
def entity_f_half(spark, sf):
    return E.entity_scores(entities(spark, sf), truth(spark, sf), scored(spark, sf).drop("label"), GRID)


@query(f"{f_half_sql(GRID)} select threshold, f_half from r order by f_half desc, threshold limit 1")
def best_threshold(spark, sf):
    rows = E.entity_scores(entities(spark, sf), truth(spark, sf), scored(spark, sf).drop("label"), GRID)
    return rows.orderBy(F.col("f_half").desc(), "threshold").limit(1).select("threshold", "f_half")


FINE = f_half_steps().replace("k as (", "k2 as (").replace("from k cross join ts left join m ", "from k2 k cross join ts2 ts left join m2 ").replace("m as (", "m2 as (").replace("join ts on", "join ts2 ts on").replace("e as (", "e2 as (").replace("from e group", "from e2 group").replace("r as (", "r2 as (")


@query(
    f"""{f_half_sql(GRID)}, best as (select threshold t from r order by f_half desc, threshold limit 1),
ts2 as (select threshold from (select round(t - 0.04::double + i * 0.002::double, 6) threshold from best cross join unnest(range(0, 41)) as u(i)) where threshold > 0 and threshold < 1), {FINE}
select threshold, f_half from r2 order by f_half desc, threshold limit 1"""
)
def threshold_search(spark, sf):
    best = E.search_threshold(entities(spark, sf), truth(spark, sf), scored(spark, sf).drop("label"))
    return spark.createDataFrame([best], "threshold double, f_half double")


@query(
    f"""with {MERGED}, k as (select s1.id q_id, count(t.c_id) links, count(m.c_id) tp from s1 left join truth t on t.q_id = s1.id left join merged m on m.q_id = t.q_id and m.c_id = t.c_id group by 1)
select round(avg(case when links = 0 then 1.0 else 1.25 * tp / (1.25 * tp + 0.25 * (links - tp)) end), 6) f_half, sum(tp)::bigint tp, sum(links - tp)::bigint fn, round(sum(tp) / sum(links), 6) recall from k"""
)
def candidate_oracle(spark, sf):
    return E.oracle(entities(spark, sf), truth(spark, sf), merged(spark, sf))


OUTCOME = "case when probability >= 0.3 and label = 1 then 'TP' when probability >= 0.3 then 'FP' when label = 1 then 'FN' else 'TN' end"


@query(
    f"""with {MERGED}, {LABELLED}, {SCORED} select {OUTCOME} outcome, count(*) pairs, count(*) filter (abs(probability - 0.3) <= 0.05) near_threshold,
 count(*) filter (probability >= 0.9 or probability <= 1 - 0.9) sure from scored group by 1"""
)
def confusion(spark, sf):
    return E.confusion(scored(spark, sf), 0.3)


@query(
    f"""with {MERGED}, {LABELLED}, s as (select *, round((0.4 * name_retrieval_score + 0.4 * address_retrieval_score + 0.02 * structured_retrieval_score), 6) probability from labelled),
x as (select {OUTCOME} outcome, 'name_retrieval_score' feature, name_retrieval_score v from s union all select {OUTCOME}, 'address_retrieval_score', address_retrieval_score from s)
select outcome, feature, count(*) n, round(avg(v), 6) mean, round(quantile_cont(v, 0.25), 6) p25, round(quantile_cont(v, 0.5), 6) median, round(quantile_cont(v, 0.75), 6) p75,
 round(count(*) filter (v = 0) / count(*), 6) at_zero, round(count(*) filter (v = 1) / count(*), 6) at_one from x group by all"""
)
def error_profile(spark, sf):
    p = 0.4 * F.col("name_retrieval_score") + 0.4 * F.col("address_retrieval_score") + 0.02 * F.col("structured_retrieval_score")
    rows = E.labelled(merged(spark, sf), truth(spark, sf)).withColumn("probability", F.round(p, 6))
    return E.error_profile(rows, 0.3, ["name_retrieval_score", "address_retrieval_score"])


@query(
    f"""with {MERGED}, v as (select 'name_retrieval_score' as "column", name_retrieval_score v from merged union all select 'address_retrieval_score', address_retrieval_score from merged),
l as (select unnest([0.2, 0.4, 0.6, 0.8])::double as "level") select "column", "level", round(avg((v >= "level")::int), 6) share from v cross join l group by all"""
)
def score_coverage(spark, sf):
    return E.coverage(merged(spark, sf), ["name_retrieval_score", "address_retrieval_score"], [0.2, 0.4, 0.6, 0.8])


@query(
    f"""with {NEAR}, m as (select q_id, c_id from truth except select q_id, c_id from near),
x as (select (case when a.country <> b.country then ['countries differ'] else [] end) || (case when {O.overlap(O.numbers("a.address"), O.numbers("b.address"))} > 0 then ['share a number'] else [] end)
 || (case when a.address = '' or b.address = '' then ['no address'] else [] end) names from m join s1 a on a.id = q_id join s2 b on b.id = c_id)
select case when len(names) = 0 then 'other' else array_to_string(names, '+') end bucket, count(*) n from x group by 1"""
)
def miss_buckets(spark, sf):
    left, right = sides(spark, sf)
    rows = missed(spark, sf)
    rows = rows.join(left.select(F.col("id").alias("q_id"), F.col("country").alias("qc"), F.col("address").alias("qa")), "q_id")
    rows = rows.join(right.select(F.col("id").alias("c_id"), F.col("country").alias("cc"), F.col("address").alias("ca")), "c_id")
    return E.failure_buckets(
        rows,
        {
            "countries differ": F.col("qc") != F.col("cc"),
            "share a number": F.size(F.array_intersect(T.numbers("qa"), T.numbers("ca"))) > 0,
            "no address": (F.col("qa") == "") | (F.col("ca") == ""),
        },
    )


@query(
    f"""with {MERGED}, {LABELLED}, {SCORED}, b as (select probability, sum(label) p, sum(1 - label) n from scored group by 1),
r as (select p, n, sum(p) over (order by probability desc) tp, sum(n) over (order by probability desc) fp from b)
select round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) average_precision from r"""
)
def score_curves(spark, sf):
    return E.curves(scored(spark, sf))


def training(spark, sf) -> DataFrame:
    both = sides(spark, sf)
    return trained_on(merged(spark, sf, both), truth(spark, sf), *both)


def trained_on(found: DataFrame, links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Mined, labelled pairs with their features."""
    pairs = E.labelled(found, links).withColumn("split", T.split_name("q_id"))
    return features.pair_features(E.mined(pairs, 20).drop("hardness"), left, right)


MINED = f"""{LABELLED}, h as (select *, round({HARD}, 6) hardness, case when {O.fraction("q_id")} < 0.2 then 'val' else 'train' end split from labelled),
kept as materialized (select * exclude (hardness, nth) from (select *, row_number() over (partition by q_id, label order by hardness desc, c_id) nth from h) where split = 'val' or label = 1 or nth <= 20)"""


@query(f"with {MERGED}, {MINED}, {FEATURE_SQL}, {WITH_RATIOS} select e.*, {ORIGIN.replace('m.*', 'm.* exclude (q_id, c_id)')} from every e join kept m on m.q_id = e.q_id and m.c_id = e.c_id")
def training_table(spark, sf):
    return training(spark, sf)


@query()
def model_importance(spark, sf):
    rows = io.stored(training(spark, sf))
    names = features.feature_names(rows)
    return learning.importance(learning.train(rows, names), names, spark)


@query()
def model_scores(spark, sf):
    rows = io.stored(training(spark, sf))
    names = features.feature_names(rows)
    return learning.scored(learning.train(rows, names), rows.where("split = 'val'"), names).select("q_id", "c_id", "label", "probability")


@query(f"with {MERGED}, {LABELLED} select label, round(avg(name_retrieval_score), 6) name_score, round(avg(address_retrieval_score), 6) address_score, count(*) n from labelled group by 1")
def means_by_label(spark, sf):
    rows = E.labelled(merged(spark, sf), truth(spark, sf))
    return rows.groupBy("label").agg(F.round(F.avg("name_retrieval_score"), 6).alias("name_score"), F.round(F.avg("address_retrieval_score"), 6).alias("address_score"), F.count("*").alias("n"))


@query(
    f"""with {MERGED}, {LABELLED}, {SCORED}, c as (select q_id, string_agg(c_id, ',' order by c_id) ids from merged group by 1), m as (select q_id, string_agg(c_id, ',' order by c_id) ids from scored where probability >= 0.4 group by 1)
select s1.id source1_entity_id, coalesce(c.ids, '') candidate_entity_ids, coalesce(m.ids, '') matched_entity_ids from s1 left join c on c.q_id = s1.id left join m on m.q_id = s1.id"""
)
def submission_lists(spark, sf):
    rows = io.stored(scored(spark, sf))
    return linkage.id_lists(entities(spark, sf), rows.select("q_id", "c_id"), rows.where("probability >= 0.4").select("q_id", "c_id"))


@query()
def inference(spark, sf):
    """Model and threshold from the training queries, lists for all; both rest on the same searches and features."""
    left, right = sides(spark, sf)
    links = io.stored(truth(spark, sf))
    rows = io.stored(linkage.featured(blockers.joint(left, right), links, left, right))
    training = blockers.without_reranking(rows.where("kept")).drop("kept")
    model, names, threshold, _ = linkage.fit(training, entities(spark, sf), links)
    return linkage.decided(model, names, threshold, customers(spark, sf), blockers.with_reranking(rows))


@query(
    """with s as (select user_id::varchar q_id, event_type c_id, max(value) score from events group by all)
select q_id, c_id, score from s qualify row_number() over (partition by q_id order by score desc, c_id) <= 3"""
)
def stream_top_k(spark, sf):
    """Best event types of every user, from the events as a stream cut into files' batches."""
    from ..streaming.topk import TopKTable

    events = table(spark, sf, "events")
    base = io.shared_folder(spark)
    source = f"{base}/in"
    pairs = events.select(F.col("user_id").cast("string").alias("q_id"), F.col("event_type").alias("c_id"), F.col("value").alias("score"))
    pairs.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state = TopKTable(f"{base}/state", 3)
    state.follow(stream, f"{base}/checkpoint").awaitTermination()
    return state.read(spark)
