"""Byte-pair merges over many words at once, and cached text tokenisation.

Ids are those of the `tokenizers` library. Its own code runs for whatever is
not plain Latin-1 (or holds a special token's string); plain chunks are
pre-tokenised by the file's own pattern and their distinct words merged in
numpy: each round merges, in every word still active, the leftmost pair of
least rank, which is the order that the library's merge queue follows."""

from __future__ import annotations

import json

import numpy as np

_FAR = np.int64(1 << 40)
CACHE = 200_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAX_WORD = 24


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordMerger:
    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        sym = _byte_symbols()
        self.inner = np.array([vocab[s] for s in sym], np.int64)
        self.final = np.array([vocab[s + end] for s in sym], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _FAR)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each (non-empty) word."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        width = int(size.max())
        mat = np.full((len(words), width), -1, np.int64)
        row = np.repeat(np.arange(len(words)), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        mat[row, col] = self.inner[raw]
        mat[np.arange(len(words)), size - 1] = self.final[raw[np.cumsum(size) - 1]]
        out: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))
        rank = self._rank(mat[:, :-1], mat[:, 1:])
        while len(rows):
            if mat.shape[1] > 1:
                p = rank.argmin(1)
                best = rank[np.arange(len(rows)), p]
                live = best < _FAR
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                done = mat[~live]
                used = (done >= 0).sum(1)
                flat = done[done >= 0].astype("<u4").tobytes()
                ends = (np.cumsum(used) * 4).tolist()
                for r, e, n in zip(rows[~live].tolist(), ends, (used * 4).tolist()):
                    out[r] = flat[e - n : e]
                rows, mat, rank = rows[live], mat[live], rank[live]
                if not len(rows):
                    break
                p, best = p[live], best[live]
            k = np.arange(len(rows))
            mat[k, p] = self.made[best]
            cols = np.arange(mat.shape[1] - 1)
            mat = np.take_along_axis(mat, cols + (cols > p[:, None]), 1)
            if mat.shape[1] > 1:
                cols = np.arange(mat.shape[1] - 1)
                rank = np.take_along_axis(rank, cols + (cols > p[:, None]), 1)
                right = p < mat.shape[1] - 1
                rank[k[right], p[right]] = self._rank(mat[k[right], p[right]], mat[k[right], p[right] + 1])
                left = p > 0
                rank[k[left], p[left] - 1] = self._rank(mat[k[left], p[left] - 1], mat[k[left], p[left]])
        return out


def _plain_find():
    """The file's pattern for plain characters: its alternatives begin with
    different characters, so the commonest may come first."""
    import re

    import regex

    def chars(kind: str) -> str:
        return "".join(c for c in map(chr, [*range(128), *range(0xA1, 0x180), *range(0x2010, 0x2028)]) if regex.match(kind, c))

    a, n = chars(r"\p{L}"), chars(r"\p{N}")
    return re.compile(rf"[{a}]+|'(?:s|t|re|ve|m|ll|d)|[^\t-\r {a}{n}]+|[{n}]").findall


class TextTokenizer:
    """Ids of texts as little-endian bytes.

    A text is cut at ASCII white space. That is exact for a file whose pattern
    drops white space, lower-cases character by character and composes nothing
    across a blank; other files are refused. Words met lately are kept in two
    generations of at most CACHE entries each."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: words can't be tokenised apart")
        if split["pattern"]["Regex"] != PATTERN:
            raise ValueError(f"{path}: another pattern")
        self.find_plain = _plain_find()
        #: characters that no normaliser touches but for a one-to-one lower case
        self.plain = regex.compile(r"[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027]*").fullmatch
        self.merger = WordMerger(spec["model"])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        if "<|" not in text and self.plain(text):
            return self.find_plain(text.lower())
        out: list[str] = []
        for c in text.encode().split():
            t = c.decode()
            if "<|" not in t and self.plain(t):
                out += self.find_plain(t.lower())
            else:
                out.append("\0" + t)  # for the library as it is
        return out

    def _learn(self, units: set[str]) -> None:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for u in units.difference(young):
            if (v := old.get(u)) is not None:
                young[u] = v
            else:
                new.append(u)
        odd = []
        short: dict[int, tuple[list[str], list[bytes]]] = {}
        for u in new:
            w = u.encode()
            if u[0] == "\0" or len(w) > MAX_WORD:
                odd.append(u)
            else:  # words of like length share a matrix
                us, ws = short.setdefault(len(w) // 4, ([], []))
                us.append(u)
                ws.append(w)
        for us, ws in short.values():
            for i in range(0, len(ws), 50_000):
                young.update(zip(us[i : i + 50_000], self.merger.encode(ws[i : i + 50_000])))
        for u, e in zip(odd, self.whole.encode_batch_fast([u.removeprefix("\0") for u in odd], add_special_tokens=False)):
            young[u] = np.array(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        units = [self._units(t) if t else [] for t in texts]
        self._learn(set().union(*units))
        get = self.young.__getitem__
        return [b"".join(map(get, u)) for u in units]


_loaded: dict[str, TextTokenizer] = {}  # one per worker process and file


def text_tokenizer(path: str) -> TextTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = TextTokenizer(path)
    return _loaded[path]
