"""Importance resampling: CRC matrices against zlib, the whole operator against plain Python, odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorscope.llm import importance_crc as I

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def _features(text, rules):
    w = _words(text)
    return [zlib.crc32(b" ".join(w[a:a + k])) % rules.buckets for k in range(1, rules.ngrams + 1) for a in range(len(w) - k + 1)]


@pytest.mark.parametrize("size", [1, 2, 7, 1023, 1024, 1025, 2048, 70_001])
def test_crc_of_spans(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 256, size * 3).astype(np.uint8)
    data = np.concatenate((data, data[:size]))
    start = np.arange(4) * size
    want = [zlib.crc32(data[s:s + size].tobytes()) for s in start]
    for key in ([0, 1, 2, 0], [0, 0, 0, 0]):  # also with colliding keys
        assert I.crc32_spans(data, start, start + size, np.array(key, np.uint64)).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aAbZ09 -_.\n\téЖ\U0001f600\x7f")), max_size=40), max_size=6), st.integers(1, 3))
def test_features(texts, ngrams):
    rules = I.ResampleRules(ngrams=ngrams, buckets=997)
    found = I.Features([t.encode() for t in texts], rules)
    assert found.n_words.tolist() == [len(_words(t)) for t in texts]
    for i, text in enumerate(texts):
        assert sorted(found.bucket[found.doc == i].tolist()) == sorted(_features(text, rules))


def _plain(docs, target, rules):
    s, t = Counter(), Counter()
    for d in docs:
        s.update(_features(d[1], rules))
    for text in target:
        t.update(_features(text, rules))
    s_all, t_all, size = s.total(), t.total(), rules.buckets
    out = []
    for n, (doc, text) in enumerate(docs):
        f = _features(text, rules)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{rules.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(_words(text))])
    fit = sorted((r for r in out if r[5] >= rules.min_words), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, r in enumerate(fit[:rules.percent * len(fit) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


def _drawn(spark, docs, target, rules):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, id string, score int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = I.draw(df, aim, carry=("doc_id", "score"), rules=rules)
    return [(r.row.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out.collect()]


_NONE = lambda r: tuple((v is not None, v) for v in r)


@pytest.mark.parametrize("rules", [I.ResampleRules(min_words=3, percent=40), I.ResampleRules(ngrams=2, buckets=64, min_words=2, percent=100)])
def test_draw_against_plain(spark, rules):
    rng = np.random.default_rng(3)
    vocab = ["alpha", "Beta", "gamma", "délta", "x" * 1500, "0"]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 12)))) for i in range(80)]
    docs += [(None, "alpha Beta gamma"), (500, None), (501, ""), (502, "--- ..."), (503, "y" * 3_000_000 + " alpha " * 40_000),
             (7, docs[7][1]), (7, docs[7][1])]
    target = ["alpha gamma gamma", None, ""]
    got, want = _drawn(spark, docs, target, rules), _plain(docs, target, rules)
    assert sorted(got, key=_NONE) == sorted(want, key=_NONE)


def test_empty_tables(spark):
    rules = I.ResampleRules(min_words=1, percent=50)
    assert _drawn(spark, [], ["a"], rules) == []
    docs = [(i, "a b c") for i in range(4)]
    assert sorted(_drawn(spark, docs, [], rules), key=_NONE) == sorted(_plain(docs, [], rules), key=_NONE)
    assert sorted(_drawn(spark, docs, [None], rules), key=_NONE) == sorted(_plain(docs, [None], rules), key=_NONE)


def test_resample_keeps_columns(spark):
    df = spark.createDataFrame([(i, "one two three", "a", i) for i in range(10)], "doc_id long, text string, weight string, rank int")
    out = I.resample(df, df, rules=I.ResampleRules(min_words=1, percent=30))
    assert out.columns == df.columns and out.count() == 3 and out.where("rank != doc_id").count() == 0
