"""Dedup operators against brute force."""

import random

import numpy as np
import pytest

from sectorscope.llm import components, line_align, simhash_trie, substring_dedup
from tests.llm.conftest import PASSAGE


# --- substring dedup --------------------------------------------------------

def _brute_repeats(rows, n=13):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - n + 1):
            if doc is not None:
                k = tuple(w[i:i + n])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i:i + n])] < doc:
                gone |= set(range(i, i + n))
        out.append((str(doc), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_substring_dedup(request, which, hot):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(df, hot=hot, shard_words=2000).collect()
    assert sorted((str(r["row"]["doc_id"]), r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == _brute_repeats(rows)


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "date"])
def test_substring_dedup_with_ids_of_any_type(spark, kind):
    # "10" comes before "9" as text, not as a number
    rows = [(9, f"x {PASSAGE}"), (10, f"{PASSAGE} y z"), (11, f"{PASSAGE} y z"), (None, PASSAGE), (10, f"{PASSAGE} y z")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    change = "date_add(date'2020-01-01', doc_id)" if kind == "date" else f"CAST(doc_id AS {kind})"
    df = df.selectExpr(f"{change} AS doc_id", "text")
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    for hot in (20_000, 1):
        got = substring_dedup.remove_repeats(df, hot=hot).collect()
        assert sorted((str(r["row"]["doc_id"]), r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == _brute_repeats(plain)


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 6))]
        automaton = substring_dedup.SuffixAutomaton()
        for k, s in enumerate(seqs):
            automaton.add(s, 10 - k)
        automaton.finish()
        for n in (1, 2, 4):
            query = [rng.randrange(4) for _ in range(12)]
            want = []
            for i in range(len(query) - n + 1):
                labels = [10 - k for k, s in enumerate(seqs) if any(s[j:j + n] == query[i:i + n] for j in range(len(s) - n + 1))]
                want.append(min(labels, default=None))
            assert automaton.first_labels(query, n) == want


# --- SimHash ----------------------------------------------------------------

def _brute_fingerprint(text):
    import re
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_components(points, radius=4):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def _near_points(rng, n):
    """Random fingerprints with many neighbours: clusters, chains and blocks of equal bits."""
    points = set()
    while len(points) < n:
        base = rng.getrandbits(64)
        points.add(base)
        for _ in range(rng.randrange(8)):
            for _ in range(rng.randrange(1, 6)):
                base ^= 1 << rng.randrange(64)
            points.add(base)
    return sorted(points)[:n]


def test_trie_roots():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 40, 400):
        points = _near_points(rng, n) if n else []
        for step in (8, 1 << 15):
            got = simhash_trie.trie_roots(np.array(points, np.uint64), 4, step).tolist()
            assert got == _brute_components(points)


@pytest.mark.parametrize("trie_size", [20_000, 1])
def test_trie_links_find_all_components(spark, trie_size):
    points = _near_points(random.Random(9), 300)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash_trie.trie_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, trie_size)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    got = [root.get(p, p) for p in signed]
    want = _brute_components(points)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    points = [_brute_fingerprint(t) for _, t in rows]
    root = _brute_components(points)
    ids = {}
    for (doc, _), c in zip(rows, root):
        if doc is not None:
            ids[c] = min(ids.get(c, doc), doc)
    want = sorted((str(d), f"{p:016x}", str(ids.get(c))) for (d, _), p, c in zip(rows, points, root))
    got = simhash_trie.near_duplicates(df, carry=("doc_id",)).collect()
    assert sorted((str(r["row"]["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = simhash_trie.keep_representatives(df)
    assert kept.columns == df.columns
    alone = sum(c not in ids for c in root)
    assert kept.where("doc_id is not null").count() == len(ids) and kept.count() == len(ids) + alone


def test_representative_of_equal_rows_is_the_smallest(spark):
    rows = [(1, "some words of a text", x) for x in ("c", "a", "b")] + [(2, "some words of a text", "0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert [tuple(r) for r in simhash_trie.keep_representatives(df).collect()] == [(1, "some words of a text", "a")]


def test_near_duplicates_of_nothing(empty):
    assert simhash_trie.near_duplicates(empty).count() == 0 and simhash_trie.keep_representatives(empty).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 201: 200}


# --- line alignment ---------------------------------------------------------

def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(12))]
        b = [rng.randrange(12) for _ in range(rng.randrange(12))]
        pairs = line_align.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    # without repeats it is a longest common subsequence
    for _ in range(100):
        a, b = rng.sample(range(15), 10), rng.sample(range(15), 10)
        assert len(line_align.patience(a, b)) == _lcs(a, b)


def _clean(df, **rules):
    got = line_align.dedup_lines(df, carry=("doc_id", "text"), rules=line_align.AlignRules(**rules)).collect()
    return sorted((str(r["row"]["doc_id"]), r["clean_text"], r["n_removed"]) for r in got)


def test_line_dedup_cases(spark):
    page = [f"line {i} of the first page" for i in range(6)]
    rows = [(1, "\n".join(page)), (2, "\n".join(["own start", *page[1:4], "", "own end"])), (3, "\n".join(page)),
            (4, "own start\nnothing else shared\nown end"), (5, page[5] + "\nnew\n" + page[0]), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _clean(df, rare_share=0.5) == [("1", rows[0][1], 0), ("2", "own start\n\nown end", 3), ("3", "", 6), ("4", "nothing else shared", 2),
                          ("5", "new", 2), ("6", None, 0), ("7", "", 0)]
    kept = line_align.remove_shared_lines(df, rules=line_align.AlignRules(rare_share=0.5))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6, 7]


def test_frequent_lines_need_company(spark):
    # "common" is in every document: alone it stays, in a block of three it goes, a full copy goes
    rows = [(i, f"own {i}\ncommon\nalso own {i}") for i in range(40)]
    rows += [(100 + i, f"start {i}\ncommon\nfoo\nbar\nend {i}") for i in range(20)] + [(200 + i, "x y\nz") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {int(d): n for d, _, n in _clean(df, rare_share=0.0)}
    assert all(got[i] == 0 for i in range(40)) and got[100] == 0 and got[200] == 0
    assert all(got[200 + i] == 2 for i in range(1, 20))
    assert all(got[100 + i] == 3 for i in range(1, 20))  # whoever has its first line first


def test_line_dedup_odd_rows(odd, empty):
    got = _clean(odd)
    assert len(got) == odd.count()
    by_id = {}
    for d, text, n in got:
        by_id.setdefault(d, []).append((text, n))
    assert by_id["1"] == [(None, 0)] and by_id["2"] == [("", 0)]
    assert sorted(n for _, n in by_id["7"]) == [0, 3]      # the copy of document 5 loses all but its first line's owner
    assert by_id["6"][0] == by_id["6"][1]
    assert by_id["None"] == [("a null id and some words", 0)] * 2
    assert PASSAGE in by_id["-3"][0][0]
    assert line_align.remove_shared_lines(empty).count() == 0
    assert line_align.remove_shared_lines(odd).columns == odd.columns


def _brute_lines(rows, rules):
    """Kept non-blank lines of each (id, text): every common run of lines with any earlier document that counts goes."""
    seqs = [[x for x in (t or "").split("\n") if x.strip()] for _, t in rows]
    df = {}
    for seq in seqs:
        for x in set(seq):
            df[x] = df.get(x, 0) + 1
    rare_df = max(1, int(rules.rare_share * len(rows)))
    out = {}
    for k, (doc, _) in enumerate(rows):
        mine, gone = seqs[k], set()
        for theirs in seqs[:k]:
            if not set(mine) & set(theirs):
                continue
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    if mine[i] != theirs[j] or (i and j and mine[i - 1] == theirs[j - 1]):
                        continue  # only where a common run starts
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                        n += 1
                    n_words = sum(max(len(x.split()), len(x.encode()) // 16) for x in mine[i:i + n])
                    if (n >= min(rules.common_lines, len(mine)) or n_words >= rules.block_words
                            or any(df[x] <= rare_df for x in mine[i:i + n])):
                        gone.update(range(i, i + n))
        out[doc] = [x for i, x in enumerate(mine) if i not in gone]
    return out


def test_lines_are_held_against_all_earlier_documents(spark):
    rng = random.Random(9)
    words = [f"w{i}" if i % 5 else " ".join([f"w{i}"] * 30) for i in range(14)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    rows = []
    for doc in range(150):
        seq = [x for _ in range(rng.randrange(4)) for x in [*rng.choice(passages), f"own {doc} {rng.random()}"]]
        rows.append((doc, "\n".join(seq) if rng.random() < 0.9 or not rows else rng.choice(rows)[1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rules in ({"rare_share": 0.0}, {"rare_share": 0.2}, {}):
        want = _brute_lines(rows, line_align.AlignRules(**rules))
        got = {int(d): [x for x in t.split("\n") if x.strip()] for d, t, _ in _clean(df, **rules)}
        assert got == want
        assert any(want[d] != [x for x in t.split("\n") if x] for d, t in rows)


def test_crossing_and_repeated_runs_go(spark):
    # patience aligns one of two crossing blocks and one of two equal ones; the others are aligned by themselves
    a, b = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    rows = [(1, "\n".join([*a, "own 1", *b])), (2, "\n".join([*b, "own 2", *a, "own 2 too", *b])), (3, "\n".join([*b, *a]))]
    got = {int(d): t for d, t, _ in _clean(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {1: rows[0][1], 2: "own 2\nown 2 too", 3: ""}


def test_pairs_do_not_grow_with_the_square(spark):
    # two blocks in either order in every document: each document meets the owners of its runs only
    blocks = [[f"{c} {i} of a block" for i in range(3)] for c in "pq"]
    for n in (50, 100):
        rows = [(i, "\n".join([*blocks[i % 2], f"own {i}", *blocks[1 - i % 2]])) for i in range(n)]
        alone = line_align.line_hashes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        owner = {}
        for r in sorted(alone, key=lambda r: r["key"]["id"]):
            for run, _, _ in line_align.block_runs(r["lines"], r["words"], frozenset(), line_align.AlignRules()):
                owner.setdefault(run, r["key"]["id"])
        assert len(set(owner.values()) - {0}) == n - 1  # only by their own lines
        got = _clean(spark.createDataFrame(rows, "doc_id long, text string"), rare_share=0.0)
        assert {int(d): t for d, t, _ in got} == {i: rows[0][1] if not i else f"own {i}" for i in range(n)}


def test_blocks_go_whoever_has_their_lines_first(spark):
    # (a) the copy of document 2 goes although 1 has p and q in another order
    df = spark.createDataFrame([(1, "p\nq"), (2, "q\np\nr"), (3, "q\np\nr")], "doc_id long, text string")
    assert [t for _, t, _ in _clean(df)][2] == ""
    # (b) a block of three frequent lines, the first of which an earlier document has
    rows = [(i, f"own {i}\ncommon\nalso own {i}") for i in range(5)]
    rows += [(100 + i, f"start {i}\ncommon\nfoo\nbar\nend {i}") for i in range(5)]
    got = {int(d): n for d, _, n in _clean(spark.createDataFrame(rows, "doc_id long, text string"), rare_share=0.0)}
    assert got == {**{i: 0 for i in range(5)}, 100: 0, **{100 + i: 3 for i in range(1, 5)}}


def test_long_passages_go_however_many_have_them(spark):
    # one or two lines of 50 words in every document go from the later ones; short frequent ones stay
    one, two = " ".join(f"x{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    unspaced = "\u65e5\u672c\u8a9e" * 100
    for n in (4, 80):
        rows = [(i, "\n".join([f"own {i}", one, f"mid {i}", *two, f"more {i}", "short one", f"end {i}", unspaced, f"z {i}"]))
                for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {int(d): (t, k) for d, t, k in _clean(df, rare_share=0.05)}
        assert got[0][1] == 0
        assert all(got[i] == (f"own {i}\nmid {i}\nmore {i}\nshort one\nend {i}\nz {i}", 4) for i in range(1, n))
