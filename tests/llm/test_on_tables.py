"""The registered queries on the small tables, held against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from matchloom.llm import queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def result(spark, name, sf=SF):
    return __spark_entry__.queries()[name](spark, sf).toPandas()


def shingles(text):
    words = [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def by_force(rows):
    """component of each row position, from all pairs that share a shingle."""
    sets = [shingles(t) for t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[own[y], own[x]] += 1
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return [root(i) for i in range(len(rows))], [len(s) for s in sets]


def test_near_duplicates(spark, docs):
    out = result(spark, "op10_minhash_neardup").sort_values("doc_id").reset_index(drop=True)
    docs = docs.sort_values("doc_id").reset_index(drop=True)
    roots, sizes = by_force(docs.text)
    assert out.doc_id.tolist() == docs.doc_id.tolist()
    assert out.n_shingles.tolist() == sizes
    assert out.component_id.tolist() == [docs.doc_id[r] for r in roots]
    assert out.kept.tolist() == [docs.doc_id[r] == i for i, r in zip(docs.doc_id, roots, strict=True)]


def test_shards(spark, docs):
    out = result(spark, "op4_range_shards").set_index("doc_id")
    assert sorted(out.index) == sorted(docs.doc_id)
    assert all(out["size"][i] == len(t.encode()) + 1 and out.text_crc32[i] == zlib.crc32(t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True))
    per = out.groupby("shard")["size"].sum()
    assert sorted(per.index) == list(range(8)) and per.max() - per.min() <= 2 * out["size"].max()
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def ceilings(size, weight):
    """Targets by sharing again and again."""
    target, open_, rest = {}, set(size), sum(size.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * size[s]}
        if not over:
            return target | {s: weight[s] * unit for s in open_}
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mix(spark, docs):
    out = result(spark, "op7_pivotal_mix")
    sizes = {i: len(WORD.findall(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert dict(zip(out.doc_id, out["size"], strict=True)) == sizes
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    total = Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total))}
    want = ceilings(total, weight)
    for s, own in out.groupby("source"):
        assert own.source_size.unique().tolist() == [total[s]]
        assert own.target.iloc[0] == pytest.approx(want[s])
        assert abs(own.taken.sum() - want[s]) <= own["size"].max()
    assert (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    again = result(spark, "op7_pivotal_mix")
    key = ["doc_id", "taken"]
    assert again[key].sort_values(key).values.tolist() == out[key].sort_values(key).values.tolist()


@pytest.mark.parametrize(("name", "label", "parts", "held"), [("op1_crf_toxicity", "toxic", 5, 0), ("op8_nbsvm_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, docs, name, label, parts, held):
    out = result(spark, name).set_index("doc_id")
    assert sorted(out.index) == sorted(docs.doc_id)
    assert all(out.held_out[i] == (zlib.crc32(str(i).encode()) % parts == held) for i in out.index)
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")[label]
    mine = out[out.held_out].join(truth, how="inner")
    assert (mine.predicted == mine[label]).mean() >= 0.93


def test_toxic_spans_are_words(spark, docs):
    out = result(spark, "op1_crf_toxicity").set_index("doc_id")
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    words = Counter()
    for i, spans in out[out.predicted == 1].spans.items():
        pairs = list(zip(spans[::2], spans[1::2], strict=True))
        words.update(text[i][a:b].lower() for a, b in pairs)
    assert {"idiot", "clown", "moron"} & {w for w, _ in words.most_common(12)}


def test_leaks(spark, docs):
    out = result(spark, "op9_tiling_decontam")
    found = set(zip(out.doc_id, out.item_id, strict=True))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    whole = {(d, i) for d, t in zip(docs.doc_id, docs.text, strict=True) for i, b in zip(items.item_id, items.text, strict=True) if b in t}
    assert whole and whole <= found
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    text, item = dict(zip(docs.doc_id, docs.text, strict=True)), dict(zip(items.item_id, items.text, strict=True))
    for d, i in found:
        own = grams(words(item[i]))
        assert len(own & grams(words(text[d]))) >= 0.3 * len(own)


def test_pipeline(spark, docs):
    out = result(spark, "pipeline")
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    assert set(out.doc_id) <= set(docs.doc_id)
    quality = result(spark, "op8_nbsvm_quality").set_index("doc_id").predicted
    assert all(quality[i] == 1 for i in out.doc_id)
    leaked = set(result(spark, "op9_tiling_decontam").doc_id)
    assert not leaked & set(out.doc_id)
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_every_operator_is_registered():
    names = set(queries.QUERIES)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 11))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows_by_force(texts, k=35):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def test_substring_dedup(spark, docs):
    out = result(spark, "op6_superkmer_dedup").set_index("doc_id")
    for i, want in zip(docs.doc_id, windows_by_force(docs.text), strict=True):
        assert (out.n_words[i], out.n_removed[i], out.kept_sha256[i]) == want
    assert out.n_removed.sum() > 0


PATTERNS = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))


def check_secrets(out, texts):
    names = ("assign", "access", "hex", "random")
    for i, t in texts.items():
        spans = base_spans(t)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert [out.n_assign[i], out.n_access[i], out.n_hex[i]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert out.base_sha256[i] == digest(text)
        every = out.spans[i].split(",") if out.spans[i] else []
        assert [s for s in every if not s.startswith("random")] == (text.split(",") if text else [])
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), names.index(s.split(":")[0])))


def test_secrets(spark, docs):
    out = result(spark, "op2_secret_scan").set_index("doc_id")
    check_secrets(out, dict(zip(docs.doc_id, docs.text, strict=True)))
    assert out.n_assign.sum() > 0 and out.n_hex.sum() > 0


def products_by_force(ids, vectors, every=20, k=20):
    import math

    rows = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    out = []
    for n, (i, q) in enumerate(rows):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(rows) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_products(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    out = result(spark, "op3_kdtree_topk")
    got = sorted(out[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None))
    assert got == products_by_force(rows.vec_id, rows.embedding)


def test_pages(spark):
    out = result(spark, "op5_html_layout").set_index("page_id").text
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    assert sorted(out.index) == sorted(pages.page_id)
    for i, page in zip(pages.page_id, pages.html, strict=True):
        shown = re.sub(r"(?is)<!--.*?-->|<head>.*?</head>|<(script|style)\b.*?</\1>", " ", page)
        import html

        words = html.unescape(re.sub(r"<[^>]*>", " ", shown)).split()
        # Marks that the layout itself adds are left out; where it adds none, every bar and dash counts.
        added = {m for m, tag in (("|", "<table"), ("-", "<li")) if tag in page.lower()}
        assert [w for w in out[i].split() if w not in added] == [w for w in words if w not in added]
