"""URL filters by a bit-parallel wildcard automaton (operator 6).

All rules and glob patterns are one automaton of Shift-And masks, as many 64-bit words as
they need: a bit for each pattern character, a mask for each byte, self-loops where a
``*`` stands. One step over a byte advances every pattern at once, and numpy does the step
for a whole batch of URLs; URLs sorted by length leave the batch as they end.

The automaton reads the canonical form ``.host<FF>path``: the host in lower case, and a
byte that no UTF-8 text holds between host and path, so that a host pattern can't match
in a path. A rule (host, path) is the glob ``*.host<FF>path*``: the host, all its
subdomains, and paths that start with the rule's. The longest fitting rule decides; if
none fits, the method's glob patterns block, and everything else is allowed.

Behaviour on odd input: a null url, or one without ``://``, has an empty host and path and
fits no rule and no host pattern; urls of any length and with any characters are read
whole; among rules of equal length the one listed first wins; repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import map_arrow, pages

#: (verdict, host, path), fixed by the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: (host glob, path glob) that block where no rule fits.
GLOBS = [("*spam*", "*"), ("*cheap-pills*", "*"), ("*casino*", "*"), ("*xxx*", "*"), ("*", "*/wp-login*"), ("*", "*.exe")]
SEPARATOR = 0xFF
ANY, STAR = -1, -2


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def glob_symbols(text: str) -> list[int]:
    out: list[int] = []
    for byte in text.encode():
        out.append({ord("*"): STAR, ord("?"): ANY}.get(byte, byte))
    return out


class Automaton:
    """All patterns at once; a pattern is a list of bytes, ANY (one character) and STAR."""

    def __init__(self, patterns: list[list[int]]):
        width = max(1, sum(max(1, sum(s != STAR for s in p)) for p in patterns))
        self.words = -(-width // 64)
        self.masks = np.zeros((256, self.words), dtype=np.uint64)
        self.keep = np.zeros((256, self.words), dtype=np.uint64)  # bits that stay on over a byte
        self.first, self.always = (np.zeros(self.words, dtype=np.uint64) for _ in range(2))
        self.last: list[tuple[int, int]] = []
        self.whole = [bool(p) and all(s == STAR for s in p) for p in patterns]
        self.empty = [not p for p in patterns]
        bit = 0
        for p in patterns:
            begin, floating = bit, False
            for s in p:
                if s == STAR:
                    if bit == begin:
                        floating = True
                    else:
                        for byte in range(256):
                            self._set(self.keep[byte], bit - 1)
                    continue
                # a character is a byte that begins one, and stays matched over its continuation bytes
                for byte in [*range(0x80), *range(0xC0, SEPARATOR)] if s == ANY else (s,):
                    self._set(self.masks[byte], bit)
                for byte in range(0x80, 0xC0) if s == ANY else ():
                    self._set(self.keep[byte], bit)
                bit += 1
            if bit == begin:  # stars alone, or nothing: a bit of its own that no byte sets
                bit += 1
            else:
                self._set(self.first, begin)
                if floating:
                    self._set(self.always, begin)
            self.last.append(divmod(bit - 1, 64))

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """texts x patterns: whether the whole text matches."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")
        state = np.zeros((n, self.words), dtype=np.uint64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        sizes = lengths[order]
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        one, top = np.uint64(1), np.uint64(63)
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if n else 1), side="right")
        for t, k in enumerate(active.tolist()):
            now = state[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.first
            moved |= self.always if t else self.first
            byte = flat[begins[:k] + t]
            state[:k] = (moved & self.masks[byte]) | (now & self.keep[byte])
        out = np.zeros((n, len(self.last)), dtype=bool)
        for j, (word, bit) in enumerate(self.last):
            out[order, j] = ((state[:, word] >> np.uint64(bit)) & one) == one
            if self.whole[j]:
                out[:, j] = True
            elif self.empty[j]:
                out[:, j] = lengths == 0
        return out


def compile_rules(rules: list[tuple[str, str, str]], globs: list[tuple[str, str]]) -> Automaton:
    patterns = [[STAR, ord("."), *host.lower().encode(), SEPARATOR, *path.encode(), STAR] for _, host, path in rules]
    patterns += [[ord("."), *glob_symbols(host), SEPARATOR, *glob_symbols(path)] for host, path in globs]
    return Automaton(patterns)


def judge(urls: list[str | None], rules: list[tuple[str, str, str]], globs: list[tuple[str, str]], automaton: Automaton) -> list[tuple]:
    """(host, path, rule, verdict, pattern) of each url."""
    split = [canonical(u) for u in urls]
    found = automaton.run([b"." + h.encode() + bytes([SEPARATOR]) + p.encode() for h, p in split])
    names = [host + path for _, host, path in rules]
    by_length = np.array(sorted(range(len(rules)), key=lambda i: (-len(names[i]), i)), dtype=np.int64)
    rule = _first(found[:, by_length], by_length)
    glob = _first(found[:, len(rules) :], np.arange(len(globs)))
    out = []
    for (host, path), i, j in zip(split, rule.tolist(), glob.tolist(), strict=True):
        j = j if host else -1
        verdict = rules[i][0] if i >= 0 else "block" if j >= 0 else "allow"
        out.append((host, path, names[i] if i >= 0 else None, verdict, "".join(globs[j]) if j >= 0 else None))
    return out


def _first(hits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Name of the first hit in each row, or -1."""
    if not len(names):
        return np.full(len(hits), -1)
    return np.where(hits.any(axis=1), names[hits.argmax(axis=1)], -1)


def filter_urls(
    df: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None, globs: list[tuple[str, str]] | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row; one narrow stage without a shuffle.

    pattern is the first matching glob, whether or not a rule overrides it.
    """
    rules = RULES if rules is None else rules
    globs = GLOBS if globs is None else globs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_rules(rules, globs)
        for batch in batches:
            rows = judge(batch.column(1).to_pylist(), rules, globs, automaton)
            made = [pa.array([r[i] for r in rows], pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    source = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return map_arrow(source, run, "page_id long, host string, path string, rule string, verdict string, pattern string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: host, path, rule and verdict of every page."""
    return filter_urls(pages(spark, sf_dir))


def _glob_sql(column: str, glob: str) -> str:
    return f"regexp_full_match({column}, '(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "')"


def oracle() -> str:
    """The same judgement by string functions."""
    upper = "".join(map(chr, range(65, 91)))
    fits = [
        f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    names = [(h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, (n, _) in zip(fits, names, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{n}' THEN '{v}'" for n, v in names) + " WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END"
    pattern = "CASE WHEN host = '' THEN NULL " + " ".join(f"WHEN {_glob_sql('host', h)} AND {_glob_sql('path', p)} THEN '{h + p}'" for h, p in GLOBS) + " END"
    return f"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split
), judged AS (
  SELECT page_id, host, path, {rule} AS rule, {pattern} AS pattern FROM parts
)
SELECT page_id, host, path, rule, {verdict} AS verdict, pattern FROM judged"""
