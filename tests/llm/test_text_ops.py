"""Operators that map whole texts, against plain Python or the public libraries."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sectorscope.llm import bpe, chunks, decontam, line_quality, token_store, url_rules
from sectorscope.session import scratch_path

TEXT = st.text(st.sampled_from(list("aB 9'.\n\t\r\u00a0\u2028\x85\x1cé日😀sdt!|")), max_size=60)


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- byte-level BPE ---------------------------------------------------------

@pytest.fixture(scope="module")
def reference_bpe():
    import tiktoken
    path, pattern = bpe.public_file("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.ByteBPE(ranks, pattern)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_chunks_lose_nothing_and_keep_pretokens(text):
    import public_tokenizers
    import regex
    pattern = regex.compile(public_tokenizers.PATTERN)
    buffer, start, end, doc = chunks.chunk_spans([b"before ", text.encode(), b" after"])
    cut = [buffer[a:b].decode() for a, b, d in zip(start, end, doc) if d == 1]
    assert "".join(cut) == text
    assert [m for c in cut for m in pattern.findall(c)] == pattern.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=40)))
def test_bpe_equals_the_library(reference_bpe, text):
    theirs, ours = reference_bpe
    text = text.encode("utf-8", "ignore").decode()
    _, packed, _ = ours.encode([b"a  ", text.encode(), None])
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == theirs.encode_ordinary(text)
    assert ours.decode(packed) == text.encode()


def test_bpe_documents(reference_bpe, documents, odd):
    theirs, _ = reference_bpe
    path, pattern = bpe.public_file("byte_bpe_50k.tiktoken")
    for df in (documents, odd):
        got = bpe.encode_documents(df, path, pattern, carry=("doc_id", "text"),
                                   output=("ids", "ids_sha256", "decoded_sha256")).collect()
        assert len(got) == df.count()
        for r in got:
            ids = theirs.encode_ordinary(r["row"]["text"] or "")
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((r["row"]["text"] or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(documents, path, pattern).select("row.doc_id", "ids"), path, pattern)
    assert {r["row"]["doc_id"]: r["text"] for r in back.collect()} == dict(_pairs(documents))


def test_chunk_cache_against_hash_collisions(monkeypatch):
    # chunks of one hash are told apart by their bytes, inside a group and against the kept ones
    monkeypatch.setattr(chunks, "span_hashes", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    cache = chunks.ChunkCache(lambda cs: [c.encode("utf-32-le") for c in cs], limit=8)
    for texts in ([b"one two six"], [b"ten two, a bb ccc dddd", b"", b"one"], [b"x" * 700 + b" " + b"y" * 700, b"x" * 700]):
        assert [p.decode("utf-32-le").encode() for p in cache.pack(texts)] == texts


def test_chunk_cache_keeps_what_is_used():
    asked = []
    cache = chunks.ChunkCache(lambda cs: asked.extend(cs) or [c.encode("utf-32-le") for c in cs], limit=20)
    for i in range(40):
        text = " ".join(["common words stay", *(f"w{chr(97 + i % 26)}{j}x{i}" for j in range(3))]).encode()
        assert cache.pack([text])[0].decode("utf-32-le").encode() == text and len(cache) <= 20
    assert asked.count(" stay") == 1


def test_chunk_cache_stays_bounded():
    cache = chunks.ChunkCache(lambda cs: [c.encode("utf-32-le") for c in cs], limit=5, long=4)
    texts = [(" ".join(f"{a}{i}" for i in range(9)) + " muchlonger").encode() for a in "abc"]
    for _ in range(2):
        assert [p.decode("utf-32-le") for p in cache.pack(texts)] == [t.decode() for t in texts] and len(cache) <= 5


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(chunks, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    cache = chunks.ChunkCache(lambda cs: [c.encode("utf-32-le") for c in cs])
    assert [p.decode("utf-32-le") for p in cache.pack([b"ab cd ab", None, b" ef"])] == ["ab cd ab", "", " ef"]


# --- token files ------------------------------------------------------------

@pytest.mark.parametrize("which", ["documents", "odd", "empty"])
def test_token_files(spark, which, request):
    from tokenizers import Tokenizer
    df = request.getfixturevalue(which)
    path = scratch_path(spark, "tokens-test")
    tokenizer_path, _ = bpe.public_file("byte_bpe_50k.json")
    token_store.write_tokens(df, path, tokenizer_path, 2)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == df.count()
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    want = sorted(((d is not None, d or 0), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
                  for d, t in _pairs(df))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids"]) for r in rows) == want
    start = 0
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order)
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    crc = {(r["start"]): r["ids_crc32"] for r in token_store.with_crc32(token_store.read_tokens(spark, path)).collect()}
    assert crc == {r["start"]: zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in rows}
    assert token_store.read_index(spark, path).count() == len(rows)


def test_token_file_format(spark, documents):
    import pyarrow.parquet as pq
    from urllib.parse import urlparse
    import glob
    path = scratch_path(spark, "tokens-format")
    token_store.write_tokens(documents, path, bpe.public_file("byte_bpe_50k.json")[0], 2,
                             layout=token_store.StoreLayout(row_group=1 << 16, page=1 << 12))
    files = glob.glob(f"{urlparse(path).path}/data/part-*.parquet")
    meta = [pq.ParquetFile(f).metadata for f in files]
    columns = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for m in meta if m.num_rows for i in range(4)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert columns["ids.list.element"].has_dictionary_page
    assert columns["doc_id"].has_column_index and columns["ids.list.element"].has_offset_index
    plan = token_store.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


# --- quality rules ----------------------------------------------------------

def test_line_rules():
    fails = line_quality.line_fails
    assert fails("A plain sentence, with words and an end.") is None and fails("  ") is None and fails("Short line") is None
    assert fails("*** --- ***") == "punctuation" and fails("word*** other$$$ third&&&") == "punctuation"
    assert fails("BUY!! NOW!! HERE!!") == "punctuation"
    assert fails("Home | About | News | Shop") == "navigation" and fails("Back to top") == "navigation"
    assert fails("© Us. All rights reserved") == "boilerplate"


def _brute_measures(text):
    import re
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_line_quality(documents, odd, empty):
    for df in (documents, odd):
        rows = line_quality.line_quality(df, carry=("doc_id", "text")).collect()
        assert len(rows) == df.count()
        for r in rows:
            text = r["row"]["text"]
            if text is not None and len(text) > 20_000:
                continue
            n, chars, symbols, dup, repeat = _brute_measures(text)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
                n, chars, symbols, dup, repeat)
            assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
            assert r["kept"] == (not r["base_failed"] and r["n_lost_words"] <= 0.3 * n)
            if r["n_lost_words"] == 0 and not any(r[f"n_{k}_lines"] for k in ("punctuation", "navigation", "boilerplate")):
                assert r["clean_text"] == text
    good = line_quality.keep_good(odd)
    assert good.columns == odd.columns and {r["doc_id"] for r in good.collect()} == {8, 9}
    assert line_quality.keep_good(empty).count() == 0


def test_failing_lines_go(spark):
    first, second = (" ".join(f"Good {k}{i} words." for i in range(20)) for k in "ab")
    half = "\n".join([f"a{i}*** b{i}&&& c{i}%%%" for i in range(12)] + [f"x{i} y{i} z{i}" for i in range(12)])
    df = spark.createDataFrame([(1, f"{first}\nHome | About | News\n{second}"), (2, half)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_quality.keep_good(df).collect()}
    assert got == {1: f"{first}\n{second}"}


# --- decontamination --------------------------------------------------------

def _brute_hits(text, items, n=13):
    import re
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = lower(text), set(), set()
    for item, body in items:
        w = lower(body)
        for win in ([w[i:i + n] for i in range(max(1, len(w) - n + 1))] if w else []):
            for i in range(len(words) - len(win) + 1):
                if words[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [32 << 20, 600])
def test_contamination(spark, odd, block_bytes):
    text = " ".join(f"w{i}" for i in range(60))
    items = [(1, text), (2, "Short ITEM, here"), (3, None), (4, "..."), (5, "short item here"), (10, "words"),
             (12, "w58 w59 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"), (None, "single")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, f"intro {text[30:160]} and more"), (2, "a Short-item; here"), (3, None), (4, ""), (5, "short item her"),
            (6, text + " " + text), (7, "w58 w59 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("length(text) < 9000 or text is null"))
    marked = decontam.mark_contamination(df, bench, carry=("doc_id", "text"), block_bytes=block_bytes).withColumn(
        "contaminated", decontam.contaminated()).collect()
    assert len(marked) == df.count()
    for r in marked:
        n, hits, names = _brute_hits(r["row"]["text"], [i for i in items if i[0] is not None])
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hits, names)
        assert r["contaminated"] == (hits > 0 and 20 * hits >= n)
    kept = decontam.remove_documents(df, bench, block_bytes=block_bytes)
    assert sorted(map(str, _pairs(kept))) == sorted(str((r["row"]["doc_id"], r["row"]["text"])) for r in marked if not r["contaminated"])
    cut = dict(_pairs(decontam.remove_spans(df.where("doc_id = 2 and text like 'a%'"), bench, block_bytes=block_bytes)))
    assert cut == {2: "a "}


def test_contamination_without_items(spark, documents, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove_documents(documents, none).count() == documents.count()
    assert decontam.remove_documents(empty, none).columns == empty.columns


# --- URL rules --------------------------------------------------------------

RULES = [url_rules.UrlRule("com", "/", "allow"), url_rules.UrlRule("example.com", "/en/", "block"),
         url_rules.UrlRule("www.example.com", "/en/", "allow"), url_rules.UrlRule("net", "/es/", "block"),
         url_rules.UrlRule("example.com", "/en/a", "allow"), url_rules.UrlRule("a.b.example.com", "", "block")]
LONG_URL = "http://example.com/en/" + "a/" * 1_000_000
URLS = [LONG_URL, None, "", "nothing", "http://example.com", "HTTP://EXAMPLE.com/EN/", "http://example.com/en/x?q#f", "x://www.example.com/en/",
        "http://www.example.com/en", "http://notexample.com/en/", "http://a.net/es/1", "http://anet/es/1", "http://b.a.b.example.com",
        "http://a.b.example.com?x=http://c.net/es/", "http:///en/", "http://com", "http://com/", "http://.com/", "http://example.com./en/",
        "http://x.example.com/en/abc", "http://example-.com/en/", "http://example.com:80/en/", "a://b://net/es/"]


def _brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("block_rules", [100, 2])
def test_url_rules(spark, block_rules):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string").repartition(4)
    got = url_rules.judge_urls(df, RULES, carry=("page_id", "url"), block_rules=block_rules).collect()
    assert len(got) == len(URLS) * 3
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == _brute_url(r["row"]["url"]), r["row"]["url"]
    assert url_rules.filter_urls(df, RULES).columns == df.columns
    assert url_rules.judge_urls(df, []).where("rule is not null or verdict != 'allow'").count() == 0
    assert url_rules.judge_urls(df.limit(0), RULES).count() == 0


def test_url_rules_of_a_table(spark):
    # a table of rules, rows with a null part and repeated rows among them, and a host with very many paths
    rows = [(r.host, r.path, r.verdict) for r in RULES] * 2 + [(None, "/", "block"), ("com", None, "block"), ("org", "/", None)]
    table = spark.createDataFrame(rows, "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for block_rules in (100, 2):
        for r in url_rules.judge_urls(df, table, carry=("page_id", "url"), block_rules=block_rules).collect():
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == _brute_url(r["row"]["url"])
    assert url_rules.judge_urls(df, table.limit(0)).where("rule is not null").count() == 0


def test_paths_of_one_host():
    import random
    rng = random.Random(4)
    paths = ["".join(rng.choice("/ab") for _ in range(rng.randrange(9))) for _ in range(3000)]
    rules = url_rules.PathRules([url_rules.UrlRule("h", p, "block") for p in paths])
    known = set(paths)
    for _ in range(2000):
        path = "".join(rng.choice("/abc") for _ in range(rng.randrange(14)))
        want = next((path[:n] for n in range(len(path), -1, -1) if path[:n] in known), None)
        got = rules.longest(path)
        assert (got and got.path) == want
