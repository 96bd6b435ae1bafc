"""Pieces, encoding, hashing and record frames against plain Python."""

import base64
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plantlens.llm import audio, bpe, decontaminate, line_dedup, ngram_join, pieces, token_records
from plantlens.llm import textmath as tm
from plantlens.llm.url_filter import Trie

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "ab'stredlvm  \n\t\r.,!12éß中\x1c\x85\u3000٣½_-🙂"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=20), max_size=4))
def test_encoding_equals_the_library(known, values):
    codec = bpe.codec(RANKS)
    for value, ids in zip(values, codec.encode(values), strict=True):
        assert ids.tolist() == known.encode_ordinary(value)
        assert codec.decode(ids) == value.encode()


def test_long_pieces_and_special_strings(known):
    for value in ("a" * 5000, "ab" * 3000 + " x", "<|endoftext|>", "x" * (pieces.CHARS + 10) + "\n\n  y", ""):
        assert bpe.codec(RANKS).encode([value])[0].tolist() == known.encode_ordinary(value)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbB \n\té,", max_size=40)), max_size=5))
def test_shingle_sets(values):
    expected = []
    for v in values:
        w = re.findall(r"[^\x20\x09-\x0D]+", (v or "").translate(str.maketrans("AB", "ab")))
        expected.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    found = list(tm.shingle_sets(pa.array(values, pa.string())))
    assert [len(f) for f in found] == [len(e) for e in expected]
    for a, ea in zip(found, expected, strict=True):
        for b, eb in zip(found, expected, strict=True):
            assert len(np.intersect1d(a, b)) == len(ea & eb)
            assert (tm.set_key(a) == tm.set_key(b)) == (ea == eb)


def test_long_text_is_cut_at_words_only():
    text = "word1 word2 " * (tm.SEGMENT // 4)
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(data) > 2 * tm.SEGMENT
    hashes, at = tm.words(data, np.array([0, len(data)]))
    assert len(hashes) == len(text.split()) == at[1] and len(np.unique(hashes)) == 2


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.lists(st.sets(st.integers(0, 40), min_size=1), max_size=8))
def test_divide_skip_equals_brute_force(query, members):
    arrays = [np.array(sorted(m), np.uint64) for m in members]
    found = ngram_join.divide_skip(np.array(sorted(query), np.uint64), arrays, (75, 100))
    assert found == [i for i, m in enumerate(members) if 100 * len(query & m) >= 75 * len(query | m)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 3000)))
def test_sketches_never_exceed_the_difference(a, b):
    x, y = (np.frombuffer(ngram_join.sketch(tm.mix(np.array(sorted(s), np.uint64))), np.uint8) for s in (a, b))
    assert int(ngram_join.apart(x, y)) <= len(a ^ b)


def test_frames_round_trip_and_notice_damage():
    ids = [np.array([1, 50256, 2], np.uint32), np.array([70000], np.uint32), np.zeros(0, np.uint32)]
    data = b"".join(token_records.frame(i, x) for i, x in zip((7, None, -3), ids, strict=True))
    at, got = 0, []
    while at < len(data):
        doc, x, at = token_records.unframe(data, at)
        got.append((doc, x.tolist()))
    assert got == [(7, [1, 50256, 2]), (None, [70000]), (-3, [])]
    for k in (0, 9, 14, 20):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken))


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 64, "long é text ".encode() * 4000])
def test_audio_keeps_the_payload(text):
    payload = audio.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text)
    assert audio.read_wav(audio.write_wav(payload)) == payload
    times, pairs = audio.fingerprint(payload)
    assert len(times) == len(pairs) and (np.diff(times) >= 0).all()


def test_spaced_seeds_find_substitutions_and_leave_others():
    item = " ".join(f"w{i}" for i in range(40))
    index = decontaminate.Index.of([(3, item), (4, "one two three four five six seven"), (5, "too short"), (6, None)])
    terms = lambda t: next(decontaminate._rows_terms(pa.array([t])))
    words = ("x y z " + item + " tail").split()
    for k in (5, 11, 17, 23, 29, 35):
        words[k] = "changed"
    assert [m[0] for m in index.matches(terms(" ".join(words)))] == [3]
    assert index.matches(terms("Before, One two THREE four five six seven!"))[0] == (4, 1, 7, 7)
    assert index.matches(terms("w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 other words and then quite a lot more of them to fill the window here")) == []
    assert index.matches(terms("")) == []


def test_lines_and_signatures():
    texts = ["a b\n\nsecond\n", "", "  \nx", "one line"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, place, s, e = line_dedup.lines_of(data, offsets)
    got = [(r, p, data[a:b].tobytes().decode()) for r, p, a, b in zip(row.tolist(), place.tolist(), s, e, strict=True)]
    assert got == [(0, 0, "a b"), (0, 2, "second"), (2, 1, "x"), (3, 0, "one line")]


@pytest.mark.parametrize(("host", "path", "rule"), [
    ("a.example.com", "/en/1", ("block", "example.com", "/en/")), ("www.example.com", "/en/", ("allow", "www.example.com", "/en/")), ("com", "/", ("allow", "com", "/")), ("x.com", "", None),
    ("a.net", "/es/x", ("block", "net", "/es/")), ("a.net", "/esx", None), ("notexample.com", "/en/", ("allow", "com", "/")), ("", "", None), ("a..com", "/en", ("allow", "com", "/")),
])
def test_trie(host, path, rule):
    from plantlens.llm.queries import URL_RULES

    assert Trie(URL_RULES).find(host, path) == rule


def test_trie_prefers_block_on_a_tie_and_longer_paths():
    trie = Trie([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "a.b", "/xy/z"), ("block", "", "/q")])
    assert trie.find("a.b", "/xyz")[0] == "block" and trie.find("c.a.b", "/xy/zz")[0] == "allow" and trie.find("c", "/q1")[0] == "block"


def test_masked_checksums_are_32_bits():
    assert 0 <= token_records.masked(zlib.crc32(b"x")) < 1 << 32
