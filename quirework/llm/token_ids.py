"""Token ids of whole texts by a public tokenizer file, several times faster than text by text.

The word tokenizer lower-cases, splits at white space and again into runs of letters,
digits and other signs, and merges each run on its own. So the ids of a text are those
of its white-space-separated chunks, joined - and chunks recur. A batch of texts is one
byte buffer: its chunks are cut and hashed with numpy, looked up in a sorted table of
64-bit hashes, and their ids are gathered from one pool; only chunks that the table lacks
become strings and go to the library, many in one call. A sign that ends a chunk behind a
letter is a chunk of its own, and A-Z are lowered first, so that the table has fewer entries. The table is bounded (about 20
bytes an entry): when it is full, the half that was used last stays. Texts with characters
outside a plain Latin set, or with the strings of special tokens, go to the library whole:
there normalisation may reach over a chunk's end.

Two chunks with one 64-bit hash would get the same ids: over 1e10 distinct chunks against
tables of 4e5, a chance of about 2e-4 that it happens once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

from quirework.llm.hashing import LOWER, SPACE, U64, PrefixHash, chunks

DEFAULT_FILE = "word_bpe_49k.json"
#: Chunks in the table, and runs of letters known as strings.
MOST_CHUNKS, MOST_RUNS = 400_000, 60_000
#: Bytes of the texts that are cut and hashed together.
BUFFER = 1 << 19
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-įĲ-ſ–—‘-„…€]")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Signs that \w, \d and the tokenizer's letter and digit classes see differently.
_ODD = re.compile(r"[ª²³µ¹º¼-¾]")
_coders: dict[str, WordCoder] = {}


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[list(b".,;:!?")] = True
_A_Z = np.zeros(256, dtype=bool)
_A_Z[97:123] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC3, 0xC4, 0xC5]] = True  # of U+00C0 to U+017F: letters, but for two signs


def _chunks_of(data: np.ndarray, starts: np.ndarray):
    """Of lowered texts in plain signs: starts and ends of chunks, the first of each text, and how many bytes of letters precede a byte."""
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    follows = (data >= 0x80) & (data < 0xC0) & _LEAD[before]
    sign = follows & (before == 0xC3) & ((data == 0x97) | (data == 0xB7))
    letter = (_A_Z[data] | _LEAD[data] | follows) & ~sign
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    last = _SPLIT[data[end - 1]] & (end - start > 1)
    last[last] = letter[end[last] - 2]
    place = np.arange(len(start)) + np.cumsum(last) - last
    cut_start, cut_end = np.empty((2, len(start) + int(last.sum())), dtype=np.int64)
    cut_start[place], cut_end[place] = start, end - last
    cut_start[place[last] + 1], cut_end[place[last] + 1] = end[last] - 1, end[last]
    return cut_start, cut_end, np.searchsorted(cut_start, starts), np.concatenate([[0], np.cumsum(letter)])


class Table:
    """Ids of chunks by the hash of a chunk: sorted keys, and a place in one pool of ids."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=U64)
        self.start = np.zeros(0, dtype=np.int32)
        self.count = np.zeros(0, dtype=np.int32)
        self.used = np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(0, dtype="<u2")
        self.now = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each (sorted) key, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def add(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New keys, sorted, with the number of ids of each and all ids end to end."""
        if len(self.keys) + len(keys) > MOST_CHUNKS:
            self._halve()
        start = (len(self.pool) + np.cumsum(count) - count).astype(np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start, self.count = np.insert(self.start, at, start), np.insert(self.count, at, count)
        self.used = np.insert(self.used, at, self.now)
        self.pool = np.concatenate([self.pool, ids])

    def _halve(self) -> None:
        keep = self.used > np.median(self.used) if len(self.used) else self.used > 0
        self.keys, self.used, count = self.keys[keep], self.used[keep], self.count[keep]
        self.pool = self.pool[spread(self.start[keep], count)]
        self.start, self.count = (np.cumsum(count) - count).astype(np.int32), count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the counts, end to end."""
    ends = np.cumsum(count, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - count), count) + np.arange(total)


class WordCoder:
    """Ids as little-endian unsigned 16-bit bytes; the vocabulary must be below 2**16."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary doesn't fit 16 bits")
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        # the same model without normalisation and splitting, for runs that are through both
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.library.model.end_of_word_suffix
        if not mark:
            raise ValueError("the vocabulary has no mark for the end of a run")
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(mark)]] = True
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self.table = Table()
        self.runs: dict[str, bytes] = {}

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each run, and all ids. Many runs go as one text; a token that ends a run says where the next begins."""
        counts, out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype="<u2")]
        for at in range(0, len(runs), 4096):
            text = " ".join(runs[at : at + 4096]).lower()
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
            counts.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
            out.append(ids)
        return np.concatenate(counts), np.concatenate(out)

    def _learn(self, found: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids; letters: which chunks are runs of letters."""
        counts = np.zeros(len(found), dtype=np.int32)
        counts[letters], of_letters = self._runs([c for c, k in zip(found, letters.tolist(), strict=True) if k])
        split = {i: _RUNS.findall(found[i].lower()) for i in np.flatnonzero(~letters).tolist()}
        if len(self.runs) > MOST_RUNS:
            self.runs = {}
        if new := list({r for runs in split.values() for r in runs if r not in self.runs}):
            many, ids = self._runs(new)
            ends = np.cumsum(many).tolist()
            self.runs.update((r, ids[e - n : e]) for r, e, n in zip(new, ends, many.tolist(), strict=True))
        joined = [np.concatenate([self.runs[r] for r in runs]) for runs in split.values()]
        counts[~letters] = [len(x) for x in joined]
        ids = np.zeros(int(counts.sum()), dtype="<u2")
        start = np.cumsum(counts) - counts
        ids[spread(start[letters], counts[letters])] = of_letters
        if joined:
            ids[spread(start[~letters], counts[~letters])] = np.concatenate(joined)
        return counts, ids

    def plain(self, text: str) -> bool:
        return not (_OTHER.search(text) or _ODD.search(text) or ("<|" in text and self.special.search(text)))

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        buffer = b"\n".join([*texts, b""])
        data = LOWER[np.frombuffer(buffer, dtype=np.uint8)]
        start, end, word_of, letter = _chunks_of(data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        keys, first, which = np.unique(PrefixHash(data).slices(start, end), return_index=True, return_inverse=True)
        table = self.table
        table.now += 1
        at, there = table.find(keys)
        table.used[at[there]] = table.now
        if not there.all():
            first = first[~there]
            lower = data.tobytes()
            found = [lower[x:y].decode() for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            table.add(keys[~there], *self._learn(found, letter[end[first]] - letter[start[first]] == end[first] - start[first]))
            at, there = table.find(keys)
            if not there.all():  # the table was halved: what this batch needs is learned once more
                return [x for t in texts for x in self._encode_plain([t])] if len(texts) > 1 else self._batch([texts[0].decode()])
        count = table.count[at][which]
        ids = table.pool[spread(table.start[at][which], count)]
        ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[word_of].tolist()
        return [ids[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        out: list = []
        plain: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            if self.plain(t):
                plain.append((i, t.encode()))
                out.append(None)
            else:
                out.append(self._batch([t])[0])
        for part in chunks(plain, lambda r: len(r[1]) + 1, BUFFER):
            for (i, _), ids in zip(part, self._encode_plain([x for _, x in part]), strict=True):
                out[i] = ids
        return out


def coder(path: str) -> WordCoder:
    """One coder for each process and file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
