"""Exact token ids by pieces: white-space runs -> pre-tokens -> the library's model.

The tokenizer drops white space and never merges across pre-tokens, so a text's ids
are those of its white-space runs in order, and a run's ids those of its pre-tokens.
Both levels are cached in the worker; a run of letters is one pre-token and cached
as a run only, and one with a full stop or the like behind it is made of the two. Whatever the small splitter here may see
differently from the library (code points above U+017F, U+0130, the four separators
U+001C to U+001F) is encoded by the library itself.

Counts of a column are taken a block of texts at a time: Arrow splits the block at ASCII white
space and gives each run a number, so a run is looked up once a block, however often it occurs.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import chunks

#: Entries of a generation of a worker's caches of pre-tokens and of runs, of which there are two each.
CACHE, RUNS = 60_000, 180_000
#: The same for counts of runs, and characters of the longest run kept there: longer ones seldom come back.
COUNTS, KEPT = 400_000, 64
#: Bytes of texts whose runs are numbered at once; one longer text is handled alone.
BLOCK = 1 << 22
_LIMIT = 0x180
# Fixed value: the split pattern that the tokenizer's file names.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _splitter() -> re.Pattern:
    kinds = {c: "".join(re.escape(chr(i)) for i in range(_LIMIT) if unicodedata.category(chr(i))[0] == c) for c in "LN"}
    space = "\t-\r \x85\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{kinds['L']}]+|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+")


SPLIT = _splitter()
STRANGE = re.compile(f"[^\\x00-\\x1b\\x20-įı-{chr(_LIMIT - 1)}]")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Marks that are pre-tokens of their own behind a run of letters, where nothing follows.
STOPS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _drops_white_space(spec: dict) -> bool:
    """Whether the file describes the steps that the splitter here repeats."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", ())]
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ({},))
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and split.get("pattern", {}).get("Regex") == FILE_PATTERN
        and split.get("behavior") == "Removed"
        and [r.get("type") for r in rest] == ["ByteLevel"]
        and not rest[0].get("add_prefix_space")
    )


class _Cache(dict):
    """Values by key; when full, it becomes the old generation, from which keys in use come back."""

    def __init__(self, make: Callable, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class _ShortCache(_Cache):
    """A cache that keeps keys of at most ``KEPT`` characters."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= KEPT else self.make(key)


def white_space_runs(texts: pa.Array) -> pa.ListArray:
    """Runs of each text between ASCII white space, those of ASCII texts in small letters.

    An empty run stands where a text begins or ends with white space.
    """
    return pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts))


def _is_letters(run: str) -> bool:
    """Whether a run is one pre-token of letters, as far as the splitter knows."""
    return run.isalpha() and (run.isascii() or STRANGE.search(run) is None)


def pretokens(run: str) -> list[str] | None:
    """Pre-tokens of a white-space run, or None if only the library may split it."""
    return None if STRANGE.search(run) else SPLIT.findall(run.lower())


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, and token counts.

    ``frequent``: {pre-token: number of ids}, looked up before the worker's cache.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", ())]
        self.known = _drops_white_space(spec)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = _byte_letters()
        self.model = self.library.model
        self.frequent = frequent or {}
        self.piece_ids = _Cache(self._piece_ids)
        self.run_ids = _Cache(self._run_ids, RUNS)
        self.piece_count = _Cache(self._piece_count)
        self.run_count = _ShortCache(self._run_count, COUNTS)

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model_ids(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isprintable()):  # such bytes stand for themselves
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(piece)]

    def _piece_ids(self, piece: str) -> bytes:
        ids = self._model_ids(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run_ids(self, run: str) -> bytes:
        if _is_letters(run):
            return self._piece_ids(run.lower())
        if run[-1] in STOPS and _is_letters(run[:-1]):
            return self.run_ids[run[:-1]] + self.piece_ids[run[-1]]
        pieces = pretokens(run)
        return self._library_ids(run) if pieces is None else b"".join(map(self.piece_ids.__getitem__, pieces))

    def _piece_count(self, piece: str) -> int:
        return len(self._model_ids(piece))

    def _run_count(self, run: str) -> int:
        if _is_letters(run):
            piece = run.lower()
            n = self.frequent.get(piece)
            return self._piece_count(piece) if n is None else n
        if run[-1] in STOPS and _is_letters(run[:-1]):
            return self.run_count[run[:-1]] + self.run_count[run[-1]]
        pieces = pretokens(run)
        if pieces is None:
            return len(self._library_ids(run)) // 4
        found = list(map(self.frequent.get, pieces))
        if None in found:
            found = [self.piece_count[p] if n is None else n for p, n in zip(pieces, found, strict=True)]
        return sum(found)

    def _odd(self, text: str) -> bool:
        return not self.known or SEPARATORS.search(text) is not None or (self.special is not None and self.special.search(text) is not None)

    def ids(self, text: str) -> bytes:
        if self._odd(text):
            return self._library_ids(text)
        return b"".join(map(self.run_ids.__getitem__, text.split()))

    def count(self, text: str) -> int:
        if self._odd(text):
            return len(self._library_ids(text)) // 4
        return sum(map(self.run_count.__getitem__, text.split()))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """``count`` of each text of a column without nulls."""
        pattern = SEPARATORS.pattern + (f"|{self.special.pattern}" if self.special else "")
        odd = pc.match_substring_regex(texts, pattern) if self.known else pa.array(np.ones(len(texts), bool))
        out = np.zeros(len(texts), np.int64)
        plain = pc.if_else(odd, "", texts)
        for i, j, *_ in chunks(plain, BLOCK):
            runs = white_space_runs(plain[i:j])
            found = runs.flatten().dictionary_encode()
            each = np.array([self.run_count[run] if run else 0 for run in found.dictionary.to_numpy(zero_copy_only=False)], np.int64)
            total = np.zeros(len(found) + 1, np.int64)
            np.cumsum(each[found.indices.to_numpy()], out=total[1:])
            out[i:j] = np.diff(total[runs.offsets.to_numpy()])
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[row] = len(self._library_ids(texts[int(row)].as_py())) // 4
        return out


_encoders: dict[str, tuple[object, Encoder]] = {}


def encoder(path: str, tag: object = None, frequent: dict[str, int] | None = None) -> Encoder:
    """One encoder a worker and file, so that its caches outlive a task; ``tag`` names the table."""
    if path not in _encoders or _encoders[path][0] != tag:
        _encoders[path] = (tag, Encoder(path, frequent))
    return _encoders[path][1]
