"""Word hashes, and what rests on them, on strings built to collide in weaker ones."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenrank.llm import ngram, packing, rans, tokens, wordhash
from tests.llm.test_ngram_lines import frame


def thue_morse(a, b, n=1024):
    """The pair of words that every polynomial modulo 2**64 with an odd base gives one hash."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


PAIRS = [thue_morse("a", "b"), thue_morse("a", "b", 64), thue_morse("xy", "yx", 256)]


def hashed(texts, **options):
    data, offsets = wordhash.buffers(pa.array(texts))
    return wordhash.hashes(data, offsets[:-1], offsets[1:], **options)


def test_no_shared_hash():
    texts = sorted({t for p in PAIRS for t in p} | {"a" * k for k in range(300)} | {f"{k:b}" for k in range(5000)} | {"\0" * k for k in range(1, 20)})
    assert len(set(hashed(texts).tolist())) == len(texts)
    assert np.array_equal(hashed(["xAZé" * 50, "B"], fold=True), hashed(["xazé" * 50, "b"]))
    assert not (hashed(["A"]) == hashed(["a"])).any()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 26])
def test_windows_depend_on_their_run_alone(width):
    h = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    got = wordhash.windows(h, width)
    assert len(got) == len(h) - width + 1 and len(wordhash.windows(h[: width - 1], width)) == 0
    runs = {}
    for k, g in enumerate(got.tolist()):
        assert runs.setdefault(tuple(h[k : k + width].tolist()), g) == g
    assert len(set(runs.values())) == len(runs)


def test_encoders_tell_units_apart(spark):
    full = Tokenizer.from_file(tokens.default_vocabulary())
    rows = [(k, t) for k, t in enumerate([t for p in PAIRS for t in p] + ["a b", "b a"])]
    want = {k: full.encode(t, add_special_tokens=False).ids for k, t in rows}
    manifest = rans.write_token_files(frame(spark, rows), rans.token_folder(spark))
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rans.read_token_files(spark, manifest).collect()} == {k: [*v, 2] for k, v in want.items()}
    assert {r.doc_id: r.length for r in packing.pack_documents(frame(spark, rows)).collect()} == {k: len(v) + 1 for k, v in want.items()}


@pytest.mark.parametrize("weak", [lambda d, a, b: np.zeros(len(a), np.uint64), lambda d, a, b: (b - a).astype(np.uint64)])
def test_encoder_compares_bytes(monkeypatch, weak):
    monkeypatch.setattr(wordhash, "hashes", weak)
    full, encoder = Tokenizer.from_file(tokens.default_vocabulary()), tokens.CachedEncoder(tokens.default_vocabulary())
    for texts in (["one", "two six", "one"], ["six", "", "eleven twelve"], ["a" * 9 + "b", "a" * 9 + "c"]):
        for _, ids, cuts in encoder.encode_batch(pa.array(texts)):
            assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_components_of_texts_that_share_nothing(spark):
    rows = [(k, t) for k, t in enumerate(t for p in PAIRS for t in p)]
    assert {r.doc_id: r.component_id for r in ngram.jaccard_components(frame(spark, rows), words=3, percent=90).collect()} == {k: k for k, _ in rows}
