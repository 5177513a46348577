"""Repeated passages on few lines against brute force."""

import random
import re

from lumenrank.llm import linededup, queries
from tests.llm.test_ngram_lines import frame

SPACE = "[\x20\x09-\x0d]+"


def brute_gone(rows, n):
    """Per row the words in a later occurrence of a run of n words, compared as bytes with their white space."""
    first, out = {}, []
    for i, text in rows:
        w = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
        gone = set()
        for k in range(len(w) - n + 1):
            at = first.setdefault(text[w[k][0] : w[k + n - 1][1]], (i, k))
            if at[0] != i or k >= at[1] + n:
                gone |= set(range(k, k + n))
        out.append([text[a:b] for k, (a, b) in enumerate(w) if k not in gone])
    return out


def corpus():
    rng = random.Random(3)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [["\n".join(own(-(-60 // lines)) for _ in range(lines))][0] for lines in (1, 2, 3, 4)]
    rows = []
    for i in range(24):
        lines = [own(rng.randint(3, 9)) for _ in range(rng.randint(2, 12))]
        lines.insert(rng.randrange(len(lines) + 1), passages[i % 4])
        rows.append((i, "\n".join(lines)))
    rows += [(30, own(5) + " " + passages[0] + " " + own(5)), (31, passages[2]), (32, own(50)), (33, "low " * 400), (34, "é\n" * 120)]
    rows += [(35, own(3) + " " + rows[26][1] + "\nend"), (36, " ".join(own(4).split() + passages[1].split()[:51])), (37, "")]
    return rows, passages


def test_passages_of_one_to_four_lines(spark):
    rows, passages = corpus()
    got = {r.doc_id: r for r in linededup.dedup_passages(linededup.dedup_lines(frame(spark, [*rows, (38, None)]))).collect()}
    assert got[38].text is None and got[38].removed_words == 0
    for p in passages:
        assert sum(p in (r.text or "") for r in got.values()) == 1
    alone = {r.doc_id: r for r in linededup.dedup_passages(frame(spark, rows)).collect()}
    for (i, text), want in zip(rows, brute_gone(rows, 51)):
        assert re.findall("[^\x20\x09-\x0d]+", alone[i].text) == want and alone[i].removed_words == len(re.findall("[^\x20\x09-\x0d]+", text)) - len(want), i
    assert alone[31].text == "" and alone[33].text.split() == ["low"] * 51
    assert linededup.dedup_passages(frame(spark, [])).count() == 0


def test_cuts_keep_lines_apart():
    cut = lambda t, *at: linededup.cut_words(t.encode(), list(at), 2)
    assert cut("a b\nc d\ne f", 2) == (b"a b\ne f", 2) and cut("a b c\nd", 1) == (b"a\nd", 2)
    assert cut("a\nb c d", 1) == (b"a\nd", 2) and cut("a b c", 0) == (b"c", 2) and cut("a b c\n", 1) == (b"a\n", 2)
    assert cut(" a b ", 0) == (b"", 2) and cut("a b c d e", 1, 2) == (b"a e", 3)


def test_query_removes_a_passage_on_one_line(spark, tmp_path):
    rows, passages = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[0].removed_words == 0 and got[4].removed_words == 60
