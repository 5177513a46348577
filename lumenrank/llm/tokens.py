"""Exact, cached encoding with a public word-level ``tokenizers`` vocabulary.

These vocabularies split text at white space, then into runs of letters and runs of marks, before
anything else. So the ids of a text are the ids of its units in a row, where a unit is such a run,
or a whole space-separated chunk if it holds anything but Latin letters and plain marks (digits,
apostrophes, special-token strings, other scripts, other white space). Natural text repeats its
units: each Python worker keeps a bounded table from a unit's 64-bit hash to its bytes and ids, and a
batch of texts is encoded by hashing, one sort and one ragged gather. New runs go to the merge model,
new chunks through the full tokenizer. Every unit is compared with the bytes that its table row was
made from; a run of texts with a unit that only has the hash of another goes through the tokenizer itself.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from lumenrank.llm import wordhash

#: Classes of a byte: 0 separator, 1 letter, 2 mark, 3 anything else. "'" (contractions) and
#: "<" (special tokens) are 3; the second bytes of À-ÿ but × and ÷ become letters by their first.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x0A]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[b for b in b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = 2
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_encoders: dict[tuple[str, int], CachedEncoder] = {}


class CachedEncoder:
    """Texts to ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, max_entries: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._full = Tokenizer.from_file(path)
        self._runs = Tokenizer(self._full.model)  # runs that are mapped to byte letters already
        self._runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._max = max_entries
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.uint64)  # sorted hashes of units, and where their ids are
        self._first = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int32)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._used = 0
        self._begin = np.zeros(0, np.int64)  # where a unit's bytes are, and how many
        self._size = np.zeros(0, np.int64)
        self._bytes = np.zeros(1 << 18, np.uint8)
        self._filled = 0

    def _learn(self, at: np.ndarray, keys: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        """Put new sorted keys at their places ``at``."""
        counts, ids = np.zeros(len(units), np.int32), [None] * len(units)
        runs = np.flatnonzero(plain).tolist()
        for i in range(0, len(runs), 4000):
            some = runs[i : i + 4000]
            words = [w if w.isascii() else self._byte_level.pre_tokenize_str(w)[0][0] for w in (units[k].decode() for k in some)]
            e = self._runs.encode(" ".join(words), add_special_tokens=False)
            got, cuts = np.array(e.ids, np.uint32), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1))
            counts[some] = np.diff(cuts)
            for k, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist()):
                ids[k] = got[a:b]
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            for k, e in zip(rest, self._full.encode_batch_fast([units[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)):
                ids[k] = np.array(e.ids, np.uint32)
                counts[k] = len(ids[k])
        flat, raw = np.concatenate(ids), np.frombuffer(b"".join(units), np.uint8)
        self._ids, first = self._append(self._ids, self._used, flat)
        self._bytes, begin = self._append(self._bytes, self._filled, raw)
        sizes = np.array([len(u) for u in units], np.int64)
        self._first = np.insert(self._first, at, first + np.cumsum(counts) - counts)
        self._count = np.insert(self._count, at, counts)
        self._begin = np.insert(self._begin, at, begin + np.cumsum(sizes) - sizes)
        self._size = np.insert(self._size, at, sizes)
        self._keys = np.insert(self._keys, at, keys)
        self._used += len(flat)
        self._filled += len(raw)

    @staticmethod
    def _append(store: np.ndarray, used: int, new: np.ndarray) -> tuple[np.ndarray, int]:
        """``store``, grown by doubling, with ``new`` after its first ``used`` values (and eight to spare)."""
        while used + len(new) + 8 > len(store):
            store = np.concatenate([store, np.zeros_like(store)])
        store[used : used + len(new)] = new
        return store, used

    def _same_bytes(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray) -> bool:
        """Whether each unit of ``data`` has the bytes of its row of the table."""
        size = last - first
        if (self._size[rows] != size).any():
            return False
        mine, stored = wordhash.lanes(data), np.ndarray(len(self._bytes) - 7, "<u8", self._bytes, strides=(1,))
        begin, at = self._begin[rows], 0
        todo = np.arange(len(rows))
        while len(todo):
            left = size[todo] - at
            if ((mine[first[todo] + at] ^ stored[begin[todo] + at]) & wordhash.FIRST[np.minimum(left, 8)]).any():
                return False
            todo, at = todo[left > 8], at + 8
        return True

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """Folded bytes, and starts, ends and plainness of the units."""
        starts, ends, _ = wordhash.spans(data, offsets, wordhash.SPACE_NEWLINE)
        kind, folded = _CLASS[data], _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = 1
        folded[lead[(data[lead + 1] < 0x9F)] + 1] += 0x20
        odd = np.maximum.reduceat(kind, starts) == 3 if len(starts) else np.zeros(0, bool)
        if odd.any():
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[odd]] += 1
            edge[ends[odd]] -= 1
            whole = np.cumsum(edge[:-1]).astype(bool)
            kind[whole] = 3
            folded[whole] = data[whole]
        change = np.zeros(len(data) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[starts] = change[ends] = True
        inside = kind > 0
        first = np.flatnonzero(change[:-1] & inside)
        last = np.flatnonzero(change[1:] & inside) + 1
        return folded, first, last, kind[first] != 3

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        folded, first, last, plain = self._units(data, offsets)
        if len(self._keys) > self._max:
            self._clear()
        uniq, example, inverse = np.unique(wordhash.hashes(folded, first, last), return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, uniq)
        known = np.zeros(len(uniq), bool)
        known[at < len(self._keys)] = self._keys[at[at < len(self._keys)]] == uniq[at < len(self._keys)]
        if not known.all():
            where = example[~known]
            raw = folded.tobytes()
            self._learn(at[~known], uniq[~known], [raw[a:b] for a, b in zip(first[where].tolist(), last[where].tolist())], plain[where])
            at = np.searchsorted(self._keys, uniq)
        rows = at[inverse]
        if not self._same_bytes(folded, first, last, rows):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids = [np.array(e.ids, np.uint32) for e in self._full.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        begin, count = self._first[rows], self._count[rows]
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self._ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return ids, total[np.searchsorted(first, offsets)]

    def encode_batch(self, texts: pa.Array, end_id: int | None = None):
        """Yield (first row, ids as uint32, n+1 offsets of ids) for runs of whole texts; null is empty.

        ``end_id``: an id put after each text.
        """
        for row, data, offsets in wordhash.blocks(texts):
            ids, cuts = self._block(data, offsets)
            if end_id is not None:
                n = len(cuts) - 1
                out = np.empty(len(ids) + n, np.uint32)
                ends = cuts[1:] + np.arange(n)
                keep = np.ones(len(out), bool)
                keep[ends] = False
                out[ends], out[keep] = end_id, ids
                ids, cuts = out, np.concatenate([[0], ends + 1])
            yield row, ids, cuts


def encoder(path: str, max_entries: int = 2_000_000) -> CachedEncoder:
    """This worker's encoder for a vocabulary; its table outlives the task."""
    key = (path, max_entries)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, max_entries)
    return _encoders[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
