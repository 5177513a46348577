"""Line dedup tells rows apart by all their columns, and keeps a user's columns of any name."""

import re

from lumenrank.llm import linededup
from lumenrank.llm.common import row_digest
from tests.llm.test_passages import SPACE, brute_gone, corpus

LINES = "\n".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(12))
ADDED = ("n_lines", "removed_lines", "removed_chunks", "removed_words")


def test_rows_that_differ_in_one_column(spark):
    rows = [(1, LINES, 1.0, {"a": 1}, [1], None), (1, LINES, 2.0, {"a": 1}, [1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x double, m map<string, int>, l array<int>, z string")
    for kept in (linededup.dedup_lines(docs), linededup.dedup_passages(docs), linededup.dedup_repeats(docs)):
        got = sorted(kept.collect(), key=lambda r: r.text or "")
        assert sum(LINES == r.text for r in got) == 1 and len(got) == 2 and len({r.x for r in got}) == 2
    assert [r.text for r in linededup.dedup_repeats(docs).collect() if r.text != LINES] == [""]


def test_equal_rows_are_one_row(spark):
    docs = spark.createDataFrame([(1, LINES), (1, LINES), (2, None), (2, None)], "doc_id long, text string")
    got = linededup.dedup_repeats(docs).collect()
    assert sorted((r.doc_id, r.text, r.removed_lines, r.removed_words) for r in got if r.text) == [(1, LINES, 0, 0)] * 2
    assert [(r.n_lines, r.removed_chunks) for r in got if r.text is None] == [(0, 0)] * 2


def test_digests_tell_null_from_values(spark):
    docs = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), (None, None), ("", "")], "a string, b string")
    assert docs.select(*row_digest(docs)).distinct().count() == 5


def test_clashing_columns(spark):
    names = ["doc_id", "text", *ADDED, "r1", "r2", "d", "o", "gone", "_row", "a.b", "kind"]
    rows = [tuple([i, LINES if i < 2 else f"alone {i}"] + [f"{n}{i}" for n in names[2:]]) for i in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = sorted(linededup.dedup_repeats(docs).collect())
    assert [c for c in got[0].__fields__ if c not in ADDED] == [n for n in names if n not in ADDED]
    assert [r["a.b"] for r in got] == [f"a.b{i}" for i in range(4)] and [r.n_lines for r in got] == [12, 12, 1, 1]
    assert [r.text for r in got] == [LINES, "", "alone 2", "alone 3"]


def test_long_texts_and_a_hot_passage(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    hot = " ".join(f"h{i}" for i in range(60))
    rows = [(0, long), (1, "own start " + long), (2, None), (3, ""), *((i, f"a{i} b{i}\n{hot}\nc{i}") for i in range(10, 400))]
    got = {r.doc_id: r for r in linededup.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == long and got[1].text == "own start" and got[1].removed_words == 30_000
    assert sum(hot in (r.text or "") for r in got.values()) == 1 and all(got[i].text.split() == [f"a{i}", f"b{i}", f"c{i}"] for i in range(11, 400))


def test_copies_of_whole_texts(spark):
    rows, _ = corpus()
    rows += [(100 + k, rows[i][1]) for k, i in enumerate((3, 3, 7, 24, 27, 30))] + [(-5, rows[8][1]), (120, rows[9][1] + " tail")]
    rows = [(i, t) for i, t in sorted(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_passages(docs).collect()}
    for (i, text), want in zip(rows, brute_gone(rows, 51)):
        assert [w for w in re.split(SPACE, got[i].text) if w] == want, i
    both = {r.doc_id: r for r in linededup.dedup_repeats(docs).collect()}
    assert both[-5].text == dict(rows)[-5] and [both[i].text for i in (8, 100, 101, 102)] == [""] * 4
    assert all(len(both[i].text) <= len(got[i].text) for i, _ in rows)


def test_packed_and_frequent_runs_give_the_same(spark):
    rows, _ = corpus()
    rows = [(i, t) for i, t in sorted(rows)] + [(200 + i, "low " * 300 + t) for i, t in rows[:6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS r1", "2 * doc_id AS r2", "doc_id", "text")
    want = brute_gone(rows, 51)
    for few in (0, 1, 5, 4096):
        got = {r.r1: set(r.gone) for r in linededup.repeats(docs, min_words=None, words=51, few=few).collect()}
        for (i, text), kept in zip(rows, want):
            w = [x for x in re.split(SPACE, text) if x]
            gone = got.get(i, set())
            if linededup.WHOLE not in gone:
                assert [x for k, x in enumerate(w) if not any(k - 50 <= s <= k for s in gone)] == kept, (few, i)
