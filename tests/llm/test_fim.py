"""Fill-in-middle transformation: a plain version, exact round trips, awkward
rows, units other than code points."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendscope.llm import fim

from .conftest import LONG, rows


def plain_version(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


TEXTS = ["", None, "a", "ab", "x<P", "<", "<S", "P>", "a<M>b", "é漢字𝄞é", "line\nline\r\n\t end ", "<<<>>>", "\x00\x00", LONG]


def test_equals_the_plain_version_and_restores(spark):
    data = [(i, t) for i in [*range(60), None] for t in TEXTS[:-1]] + [(i, LONG) for i in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = fim.transform(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = got.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_units_cut_at_their_borders(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour " * 5) for i in range(40)] + [(99, "  ")], "doc_id long, text string")
    got = fim.transform(docs, unit=r"\S+\s*", fim_percent=100, sentinels=("[pre]", "[suf]", "[mid]"))
    for r in got.withColumn("back", fim.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect():
        assert r.back == r.text
        if r.doc_id == 99:  # the unit doesn't tile it
            assert (r.n, r.form, r.output) == (0, "plain", r.text)
        else:
            assert r.n == 20 and (r.prefix_chars == 0 or r.text[r.prefix_chars - 1].isspace())


@pytest.mark.parametrize("bad", [("<P>", "<P>x", "<M>"), ("aba", "c", "d"), ("ab", "bc", "d"), ("", "a", "b")])
def test_overlapping_sentinels_are_refused(bad):
    with pytest.raises(ValueError):
        fim.check_sentinels(bad)


def test_awkward_and_empty(spark, awkward, empty):
    got = fim.transform(awkward.withColumn("output", F.lit(1)))
    assert got.count() == awkward.count() and dict(got.dtypes)["output"] == "string"
    assert rows(got, "doc_id", "score", "epoch") == rows(awkward, "doc_id", "score", "epoch")
    assert fim.transform(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**12), st.text(alphabet="<>PSMab\n𝄞", max_size=40))
def test_sentinels_are_found_again(doc_id, text):
    """The split that restore() does, in Python, on outputs whose parts end
    and begin with pieces of sentinels."""
    _, form, _, _, out = plain_version(doc_id, text)
    if form == "plain":
        assert out == text
        return
    first, second = ("<P>", "<S>") if form == "psm" else ("<S>", "<P>")
    head, rest = out.split(second, 1)
    mid, last = rest.split("<M>", 1)
    head = head[len(first):]
    assert (head + last + mid if form == "psm" else mid + last + head) == text
