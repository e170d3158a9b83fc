"""The indexed search finds what the full search finds, and tests fewer rows."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sectorscope.operators import explore, search_index

_ATOM = st.one_of(st.sampled_from(["abc", "aB", "c", "bca", ".", "[ab]", r"\w", "é", "^", "$", r"\b", "sK"]))
_PATTERN = st.recursive(_ATOM, lambda p: st.one_of(
    st.lists(p, min_size=1, max_size=4).map("".join), st.lists(p, min_size=2, max_size=3).map(lambda x: f"({'|'.join(x)})"),
    st.tuples(p, st.sampled_from(["?", "*", "+", "{2}", "{1,2}", "{1,3}?"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    p.map(lambda x: f"(?={x})")), max_leaves=8)


def _held(text):
    text = text.translate(str.maketrans(*search_index._ALIKE)).lower()
    return {text[i:i + 3] for i in range(len(text) - 2) if text[i:i + 3].isascii()}


@settings(max_examples=1500, deadline=None)
@given(_PATTERN, st.text(st.sampled_from(list("abcABCéskſK ")), max_size=14))
def test_a_match_holds_an_alternative(pattern, text):
    alternatives = search_index.required_trigrams(pattern)
    if alternatives is not None and re.search(pattern, text, re.IGNORECASE):
        assert any(a <= _held(text) for a in alternatives), (alternatives, pattern)


def test_required_trigrams():
    def need(*args, **kw):
        found = search_index.required_trigrams(*args, **kw)
        return found and set(found)

    assert need("licen[cs]e|passw") == {frozenset({"lic", "ice", "cen"}), frozenset({"pas", "ass", "ssw"})}
    assert need("a.*b") is None and need("(abc)?") is None and need(r"\Qabc\E") is None and need("ab|abcd") is None
    assert need("a(bc|xy)d+") == {frozenset({"abc", "bcd"}), frozenset({"axy", "xyd"})}
    assert need("a.*b", literal=True) == {frozenset({"a.*", ".*b"})}


def test_indexed_search(spark, scratch):
    rows = [(1, "The Licence", None), (2, "licen", "PASSWORD"), (3, None, None), (4, "ſecret paſsw", "x"), (5, "lic ice cen", "e"),
            (6, "", "no"), (7, "l\nicense", "licenses")]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)
    path = scratch("postings")
    search_index.build_index(df.where("id < 5"), "id", path)
    search_index.build_index(df.where("id >= 5"), "id", path, mode="append")
    for pattern, literal, tested in (("licen[cs]e|passw", False, {1, 2, 4, 5, 7}), ("a.*b", False, {1, 2, 3, 4, 5, 6, 7}),
                                     ("licen", True, {1, 2, 5, 7}), ("zzzz", False, set()), ("secret", False, {4})):
        found, looked = search_index.search_indexed(df, "id", path, pattern, literal)
        assert {r["id"] for r in looked.collect()} == tested
        assert {r["id"] for r in found.collect()} == {r["id"] for r in explore.search(df, pattern, literal).collect()}
    assert df.where(F.col("id") < 0).count() == 0
