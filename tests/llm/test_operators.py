"""Every operator over one small awkward table: nulls, empties, ties, repeats, clashing names."""

import hashlib
import itertools
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import audio, bpe, decontaminate, line_dedup, ngram_join, quality, sharding, token_records, toxicity, url_filter
from plantlens.llm.queries import TOKENIZERS, URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int, score double"
WORDS = [f"word{i}" for i in range(400)]


def prose(k, n=60):
    return " ".join(WORDS[(k * 37 + i * i * (k + 3)) % 400] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1)
    near = base.replace(base.split()[30], "swapped", 1)
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n "), (7, "short one"), (8, "SHORT one"), (9, prose(2)), (10, prose(2) + "\n" + prose(3)), (11, "long " * 20000), (12, prose(4) + "\nshared line of the corpus here"), (13, "shared line of the corpus here\n" + prose(5)), (13, "shared line of the corpus here\n" + prose(5)), (None, prose(6))]
    return spark.createDataFrame([(i, t, None if i == 1 else "en", f"src{(i or 0) % 3}", None if t is None else len(t), "k", 1, 0.5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 1), (10, 1, 0), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")


def components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(sets[a]), least.get(find(a), i)) for a, (i, _) in enumerate(rows) if i is not None)


def test_ngram_join_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.components_of(docs).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)


def test_ngram_join_of_dense_and_split_groups(spark, monkeypatch):
    from plantlens.llm import setjoin

    monkeypatch.setattr(setjoin, "CHUNK", 4)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        w = prose(7, 80).split()
        for k in rng.choice(80, int(rng.integers(0, 6)), replace=False):
            w[k] = f"new{rng.integers(0, 50)}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components_of(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)


def test_ngram_join_counts_every_list_that_two_sets_share(spark):
    """Pairs with 86 of 114 shingles in common, all their shared short lists of the same three
    sets: a text with their passage stands first in these lists, and six more make all other
    words' lists long."""
    rows = []
    for g in range(40):
        w = lambda name, n: [f"{name}{g}x{k}" for k in range(n)]  # noqa: B023, E731
        passage, common = w("passage", 16), w("common", 78)
        rows += [(20 * g, passage + w("one", 10) + common), (20 * g + 1, passage + w("two", 10) + common), (20 * g + 2, passage + w("other", 60))]
        rows += [(20 * g + 3 + k, w(f"own{k}of", 200) + common + w("own", 1) + w("other", 60)) for k in range(6)]
    rows = [(i, " ".join(x)) for i, x in rows]
    got = ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)
    assert sum(r.component_id != r.doc_id for r in got) == 40


def test_line_dedup_keeps_one_of_each(docs):
    got = {(r.doc_id, r.place): (r.rep_doc_id, r.rep_place, r.keep) for r in line_dedup.decide(docs).collect()}
    assert got[1, 0] == (1, 0, True) and got[2, 0] == (1, 0, False) and got[3, 0] == (1, 0, False)
    assert got[12, 1][2] and got[13, 0] == (12, 1, False) and got[10, 0] == (9, 0, False) and got[10, 1][2]
    assert got[8, 0] == (7, 0, False)  # alike but for case
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert out[4] is None and out[5] == "" and out[2] == "" and out[12].endswith("shared line of the corpus here") and not out[13].startswith("shared")
    assert line_dedup.dedup(docs).columns == docs.columns


def test_rows_of_one_doc_id_keep_their_own_texts(spark):
    a, b = prose(1), prose(9)
    near = a.replace(a.split()[30], "swapped", 1)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, near), (3, b + " more"), (4, prose(11)), (4, prose(11)), (None, a), (5, None), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, ""), (2, b), (3, ""), (3, ""), (4, prose(11)), (4, prose(11)), (None, a), (5, None), (5, None)], key=str)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.first_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (4, prose(11)), (4, prose(11)), (None, a), (5, None), (5, None)], key=str)


def test_line_dedup_recall_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines, at = {}, {}
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for r in docs.collect():
        for k, x in enumerate((r.text or "").encode().split(b"\n")):
            if x.strip(b" \t\v\f\r"):
                x = x.translate(fold)
                at[r.doc_id, k] = x
                lines.setdefault(x, {x[i : i + 7] for i in range(max(1, len(x) - 6))})
    names, sets = list(lines), list(lines.values())
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    # of the sets' rarest quarter, two alike share one at least
    near = set()
    for i, s in enumerate(sets):
        for g in sorted(s, key=lambda g: (len(holders[g]), g))[: len(s) - -(-3 * len(s) // 4) + 1]:
            near |= {(min(i, j), max(i, j)) for j in holders[g] if j != i and 3 * max(len(s), len(sets[j])) <= 4 * min(len(s), len(sets[j]))}
    near = [(i, j) for i, j in near if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    rep = {}
    for r in line_dedup.decide(docs).collect():
        rep.setdefault(at[r.doc_id, r.place], set()).add((r.rep_doc_id, r.rep_place))
    assert all(len(x) == 1 for x in rep.values()) and set(rep) == set(names)
    assert len(near) > 100 and np.mean([rep[names[i]] == rep[names[j]] for i, j in near]) >= 0.98
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in near:
        parent[find(i)] = find(j)
    where = {n: i for i, n in enumerate(names)}
    assert all(find(where[n]) == find(where[at[next(iter(x))]]) for n, x in rep.items())  # nothing is merged that isn't linked


def test_bpe_and_records(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    docs = docs.union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(20)).withColumn("text", F.lit("hello <|endoftext|> world<|endoftext|>")))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    start = 0
    for r in sorted(token_records.record_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json").collect(), key=lambda r: r.start):
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards_are_even_and_whole(docs):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_documents(docs, shards=4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_the_permutation_follows_from_rows_and_seed(spark, docs):
    docs = docs.where("doc_id <> 13").withColumn("position", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("slot", F.lit(3))
    shards = lambda df, seed=42: {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(df, shards=3, seed=seed).collect()}
    first = shards(docs)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert shards(docs.repartition(5)) == first and shards(docs, 1) != first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_audio_of_equal_texts(docs):
    rows = {r.doc_id: r for r in audio.describe(docs).collect()}
    assert rows[1].feature == rows[2].feature and rows[4].n_bytes == 0 and rows[4].payload_bytes == 64 and rows[4].feature == rows[5].feature


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, prose(2, 50)), (2, None), (3, "tiny")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()} == {(9, 1), (10, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items, block_bytes=100).collect()} == {(9, 1), (10, 1)}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 2


def test_decontamination_of_repeated_terms():
    for period in (1, 2, 7):
        item, doc = [f"t{k % period}" for k in range(300)], ["x"] * 5 + [f"t{k % period}" for k in range(9000)] + ["y"] * 9
        index = decontaminate.Index.of([(1, " ".join(item)), (2, "six short words of an item")])
        data = np.frombuffer((" ".join(doc) + " six short words of an item").encode(), np.uint8)
        t, _ = decontaminate.terms(data, np.array([0, len(data)]))
        began = time.time()
        assert index.matches(t) == [(1, *alignments(t, index.items[0])), (2, len(t) - 6, 6, 6)]
        assert time.time() - began < 20


def alignments(doc, item):
    """(start, terms, equal terms) of the best overlap of two lists of terms, by every offset."""
    w, best = min(24, len(item)), None
    for d in range(w - len(item), len(doc) - w + 1):
        lo, hi = max(0, d), min(len(doc), d + len(item))
        equal = np.append(0, np.cumsum(doc[lo:hi] == item[lo - d : hi - d]))
        good = np.flatnonzero(10 * (equal[w:] - equal[:-w]) >= 8 * w)
        if len(good):
            a, b = int(good[0]), int(good[-1]) + w
            value = (lo + a, b - a, int(equal[b] - equal[a]))
            if best is None or (value[2], -value[0]) > (best[2], -best[0]):
                best = value
    return best


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 3000, n) for n in range(12, 61)]
    docs = [rng.integers(0, 3000, 80)]
    for item in items:
        for phase in (*range(6), *[None] * 6):
            copy = item[int(rng.integers(0, max(1, len(item) - 24))) :][: int(rng.integers(20, 61))].copy()
            at = np.arange(phase, len(copy), 6) if phase is not None else rng.choice(len(copy), int(rng.integers(1, 2 + len(copy) // 5)), replace=False)
            copy[at] += 5000
            docs.append(np.concatenate([rng.integers(0, 3000, int(rng.integers(0, 30))), copy, rng.integers(0, 3000, int(rng.integers(0, 30)))]))
    text = lambda t: " ".join(f"T{x}" for x in t)
    d = spark.createDataFrame([(i, text(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, text(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {(i, k, *v) for i, t in enumerate(docs) for k, item in enumerate(items) if np.isin(t, item).sum() >= 10 and (v := alignments(t, item))}
    assert len(want) > 300 and {tuple(r) for r in decontaminate.find(d, b).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == set(range(len(docs))) - {x[0] for x in want}


@pytest.mark.parametrize("n", range(12, 25))
def test_decontamination_finds_every_placement(n):
    index = decontaminate.Index.of([(7, " ".join(WORDS[:n]))])
    for unequal in itertools.combinations(range(n), n // 5):
        t = index.items[0].copy()
        t[list(unequal)] = 0
        (found,) = index.matches(t)
        assert found == (7, 0, n, n - n // 5)


def test_toxicity_learns_pairs_that_weights_miss():
    rng = np.random.default_rng(1)
    sets, y = [], []
    for _ in range(600):  # toxic: both of 1 and 2, or none; each alone says nothing
        a, b = rng.integers(0, 2, 2)
        sets.append(np.array([k for k, on in ((1, a), (2, b), (3, 1)) if on]))
        y.append(float(a == b))
    m = toxicity.fit(np.arange(3), np.arange(1, 4), sets, np.array(y))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    p = m.raw(rows, np.concatenate(sets), len(sets)) > 0
    assert (p == (np.array(y) > 0.5)).mean() > 0.95


def texts_by_law(toxic, share, fillers=300):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        w = [f"filler{x}" for x in rng.integers(0, fillers, 20)]
        a, b = (rng.random(2) < share).tolist()
        if a:
            w.insert(3, "insultword")
        if b:
            w.append("groupword")
        rows.append((i, " ".join(w), int(toxic(a, b) if toxic else rng.random() < 0.3)))
    return rows


def right_share(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("held_out").join(df, "doc_id")
    return got.agg(F.avg((F.col("score").between(0.5, 1).cast("int") == F.col("toxic")).cast("int")).alias("right")).first().right


@pytest.mark.parametrize(("toxic", "share"), [(lambda a, b: a and b, 0.6), (lambda a, b: a == b, 0.5)])
def test_toxicity_of_pairs_from_texts_to_scores(spark, monkeypatch, toxic, share):
    rows = texts_by_law(toxic, share)
    assert right_share(spark, rows) > 0.95
    if share == 0.5:  # neither word says anything alone, so that it takes the pair to choose them
        monkeypatch.setattr(toxicity, "pair_terms", lambda held, y: np.zeros(0, int))
        assert right_share(spark, rows) < 0.7


def test_toxicity_chooses_no_noise(spark):
    df = spark.createDataFrame(texts_by_law(None, 0.5, 1500), "doc_id long, text string, toxic int")
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(machine.buckets) < 40  # of 1,502 words and their beginnings


def test_toxicity_of_repeated_labels(spark, labels):
    docs = spark.createDataFrame([(i, f"clean words {i}") for i in range(50)] + [(i, f"bad words {i}") for i in range(50, 100)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 50)) for i in range(100)], "doc_id long, toxic int")
    once = {r.doc_id: r.score for r in toxicity.score_documents(docs, marks).collect()}
    again = marks.union(marks.where("doc_id = 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    assert once == {r.doc_id: r.score for r in toxicity.score_documents(docs, again).collect()} and once[99] > 0.7 > 0.3 > once[0]


def test_toxicity_and_quality_of_awkward_rows(spark, docs, labels):
    for r in toxicity.score_documents(docs, labels).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.score_documents(docs, labels.where("1 = 0")).where("score <> 0.5").count() == 0
    assert quality.score_documents(docs, labels).count() == docs.count()
    assert quality.score_documents(docs, labels.where("1 = 0")).where("score <> 0.5").count() == 0


def test_what_the_views_teach_equals_brute_force(spark, docs):
    docs = docs.union(docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100)).union(docs.limit(0))
    inputs = quality.derive(docs).checkpoint()
    rng = np.random.default_rng(2)
    views = [quality.Linear(rng.normal(0, 1, n)) for n in (quality.CONTENT, quality.META)]
    rows = {}
    for r in inputs.collect():
        if r.doc_id not in (1, 9):
            rows.setdefault(r.key, quality._pair(r))
    taken = {min(rows)}
    want = {}
    for v in (0, 1):
        raw = {k: sum(views[v].weights[i] for i in x[v]) / max(1, len(x[v])) ** 0.5 for k, x in rows.items() if k not in taken}
        for label, n, side in ((0, 2, 1), (1, 3, -1)):
            for _, k in sorted((side * x, k) for k, x in raw.items() if side * x < 0)[:n]:
                want.setdefault(k, (v, float(label)))
    got = quality.picker(inputs, {1, 9, None})(views, taken, 2, 3)
    assert {k: (v, y) for v, y, k, _ in got} == want and len(want) > 4


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught")).first()
    assert got.right > 0.98 and got.caught > 0.85
    kept = quality.score_documents(docs, labels).join(labels, "doc_id").agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int")).alias("right")).first()
    assert kept.right > 0.93


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/a?x"), (2, None), (3, "no scheme"), (4, "https://a.net"), (5, "ftp://b.net/fr/?q"), (6, "x://y://com/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.net", "", None, "allow") and got[5] == ("b.net", "/fr/", "net/fr/", "block") and got[6][0] == "y:"
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, URL_RULES, block_rules=2).collect()} == got
    assert url_filter.judge(pages.where("1 = 0"), URL_RULES).count() == 0
    began = time.time()
    assert url_filter.Trie(URL_RULES).find("a.net", "/fr/" + "x" * 2_000_000) == ("block", "net", "/fr/") and time.time() - began < 1


@pytest.mark.parametrize("call", [
    lambda d, b, e: ngram_join.components_of(e), lambda d, b, e: line_dedup.decide_documents(e), lambda d, b, e: bpe.encode_documents(e, f"{TOKENIZERS}/byte_bpe_50k.tiktoken"),
    lambda d, b, e: sharding.shard_documents(e), lambda d, b, e: audio.describe(e), lambda d, b, e: decontaminate.find(e, b), lambda d, b, e: token_records.record_documents(e, f"{TOKENIZERS}/byte_bpe_50k.json"),
    lambda d, b, e: toxicity.score_documents(e, b.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("toxic"))), lambda d, b, e: quality.score_documents(e, b.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("quality"))),
])
def test_empty_tables(spark, docs, call):
    items = spark.createDataFrame([], "item_id long, text string")
    assert call(docs, items, docs.where("1 = 0")).count() == 0
