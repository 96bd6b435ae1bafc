"""Vector codes, archives and the resampled draw against plain versions of the same rules."""

import hashlib
import base64
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import resampling, vector_codes, warc

# -- vector codes ------------------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """(id, code, error) of each kept row, and the last codebooks."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: r)[:entries]
    w = len(first[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v in kept:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, books[p], strict=True)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v in kept]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)], books


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_brute_force(spark, entries):
    rng = np.random.default_rng(11)
    good = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], int(i % 3)) for i in range(90)]
    good += [(90 + i, good[7][1], None) for i in range(60)]  # one vector very often
    good += [(3, good[3][1], 0), (3, good[4][1], 0), (None, good[9][1], 1), (200, [0.5] * 8, None)]
    bad = [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, 1), (304, [], 1), (305, [1.0] * 6, 1), (306, [1.0] * 4, 1)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in good + bad], "vec_id long, embedding array<float>, label int, code string, v double").repartition(5)
    want, books = coded([r[:2] for r in good], 4, entries, 3)
    by_label = {}
    for (_, _, label), (_, _, error) in zip(good, want, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    got = vector_codes.compress(df, 4, entries, 3).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((i, c, e, by_label[g[2]]) for g, (i, c, e) in zip(good, want, strict=True)), key=str)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert vector_codes.compress(df.where("1 = 0")).count() == 0 and vector_codes.compress(df.where("vec_id > 299 and vec_id < 305")).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 4, 9])
def test_bounds_hold_the_distances(bits):
    rng = np.random.default_rng(bits)
    entries = np.concatenate([rng.integers(-900, 900, (60, 6)), np.zeros((5, 6), int), rng.integers(0, 2, (20, 6))])
    queries = np.concatenate([rng.integers(-1500, 1500, (300, 6)), entries[:40], np.zeros((3, 6), int)])
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    held = vector_codes.Approximation.of(entries, bits)
    lower, upper = held.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, distance = held.nearest(queries)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if bits == 4:  # most entries aren't looked at
        assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.3


def test_far_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 4, 0)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="exceeds"):
        vector_codes.compress(df).collect()


# -- archives ----------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/x y\r\nEvil: 1", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://b.example/é", "<p>same</p>"), (4, "http://c.example/", None), (5, "http://c.example/", ""),
    (6, "u", "WARC/1.1\r\n\r\n\r\n<p>ünïcode</p>"), (7, "u", "long " * 300_000), (8, "u", "one of its kind"), (8, "u", "one of its kind"), (None, "u", "<p>same</p>"), (None, "u", "nobody's"), (None, "v", "nobody's"),
] + [(100 + k, f"http://d.example/{k}", f"<html><body>page {k} {k * k}" + "<p>what all pages have in common</p>" * 5) for k in range(60)]


def archived(rows, least):
    size = lambda h: len((h or "").encode())
    out = []
    for i, _, h in rows:
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        again = size(h) >= least and bool(ids) and i != max(ids)
        out.append((i, size(h), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if again else "response", max(ids) if again else None))  # noqa: S324
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", 1) for r in PAGES], "page_id long, url string, html string, digest string, rep int").repartition(3)


@pytest.mark.parametrize("least", [0, 12])
def test_archives_equal_brute_force(pages, least):
    got = warc.archive_pages(pages, least).collect()
    assert sorted((tuple(r) for r in got), key=str) == archived(PAGES, least)
    assert warc.archive_pages(pages.where("1 = 0"), least).count() == 0


def test_files_are_frames_with_their_dictionary(spark, pages, tmp_path):
    import zstandard

    warc.write_archives(pages, str(tmp_path / "archives"))
    files = [p.read_bytes() for p in (tmp_path / "archives").glob("part-*")]
    read = 0
    for data in files:
        magic, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        assert magic == 0x184D2A5D and size > 0
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        whole = plain.stream_reader(data, read_across_frames=True).read()  # any reader that knows the dictionary
        mine = list(warc.frames(memoryview(data)))
        assert b"".join(mine) == whole
        read += len(mine)
        fields, block = warc.parse(mine[0])
        assert fields["content-type"] == "application/http;msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert read == len(PAGES)
    urls = {r.page_id: r.url for r in warc.read_archives(spark, str(tmp_path / "archives")).collect()}
    assert urls[1] == "http://a.example/x%20y%0D%0AEvil:%201" and urls[2] is None and urls[9] == "http://b.example/é"
    at = files[0].index(warc.FILLER)
    with pytest.raises(ValueError, match="no frame|cut off|length"):
        list(map(warc.parse, warc.frames(memoryview(files[0][: at - 3]))))


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    import zstandard

    good = warc.record(1, "u", b"payload", warc.base32(hashlib.sha1(b"payload").digest()), None, False, "1970-01-01T00:00:00Z")  # noqa: S324
    (tmp_path / "part-0").write_bytes(zstandard.compress(good.replace(b"payload", b"Payload")))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(tmp_path)).collect()


# -- the draw ----------------------------------------------------------------------------


def resampled(rows, goal, buckets, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in rows]), (t, goal)):
        for x in texts:
            for w in words(x):
                held[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        w = words(x)
        weight = sum(gain[bucket(y)] for y in w)
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_the_draw_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pool = [f"Wort{k}" for k in range(50)] + ["naïve", "日本語", "x_y", "a-b", "THE", "the"]
    rows = [(k, " ".join(rng.choice(pool, int(rng.integers(1, 60))))) for k in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (500, None), (501, ""), (502, " ,. "), (503, "the " * 50_000), (504, "the")]
    goal = ["Wort1 wort2 the naïve", None, "", "wort3 日本語 unseen"]
    df = spark.createDataFrame([(i, x, "f", 3) for i, x in rows], "doc_id long, text string, feature string, n int").repartition(4)
    target = spark.createDataFrame([(k, x) for k, x in enumerate(goal)], "item_id long, text string")
    want = resampled(rows, goal, 40, 30, 20)
    assert sorted((tuple(r) for r in resampling.resample(df, target, buckets=40, percent=30).collect()), key=str) == want
    monkeypatch.setattr(resampling, "BLOCK", 1000)  # many blocks
    assert sorted((tuple(r) for r in resampling.resample(df, target, buckets=40, percent=30).collect()), key=str) == want
    none = target.where("1 = 0")
    assert resampling.resample(df.where("1 = 0"), target).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(df, none).collect()), key=str) == resampled(rows, [], 10_000, 10, 20)


def test_runs_of_several_words(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "b")], "doc_id long, text string")
    got = resampling.counted(df, 2).where("place is not null").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    assert {r.feature: r.n for r in got} == {"a": 2, "b": 3, "a b": 2, "b a": 1}
    assert {r.doc_id: r.n_features for r in resampling.weights(df, df.select("text"), 100, 2).collect()} == {1: 7, 2: 1}
