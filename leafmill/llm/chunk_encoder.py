"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per batch and cache.

The library needs about a microsecond a byte.  Texts repeat their words, so a batch is cut into chunks at blanks,
its distinct chunks are found by Arrow, without a comma or full stop after a letter or digit, and only chunks that the
cache lacks reach the library's model.  The ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids`` for
every text: chunks are cut only where the tokenizer itself always ends a pre-token, and a text with any other white
space there is encoded as a whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

CACHE_ENTRIES = 250_000
#: Pieces of a few characters that are kept by themselves: line ends, signs behind a word.
SHORT, SHORT_ENTRIES = 4, 20_000
#: Characters for which lower case and normal form are the same in every library; other chunks go the library's whole way.
PLAIN = re.compile("[ \n\x21-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
FIRST, RUN = "\x00", "\x01"


def byte_table() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: A last character that is a pre-token of its own.
TAIL = "[A-Za-z0-9À-ÖØ-öø-ÿ][,.]$"


class Cache:
    """At most ``entries`` entries in two generations: when the young one is full it becomes the old one, and what
    the old one is asked for comes back, so frequent words stay."""

    def __init__(self, entries: int | None = None):
        self.entries = entries or CACHE_ENTRIES
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str], make) -> list[bytes]:
        """The values of distinct keys; those that are missing are made."""
        found = list(map(self.young.get, keys))
        for i, value in enumerate(found):
            if value is None:
                key = keys[i]
                value = self.old.get(key)
                if value is None:
                    value = make(key)
                if len(self.young) >= self.entries // 2:
                    self.young, self.old = {}, self.young
                found[i] = self.young[key] = value
        return found


#: Stands for the ids of a chunk whose ends don't allow to cut there.
UNSAFE = b"\xff"


class ChunkEncoder:
    """``pattern`` is the tokenizer's own pre-token pattern for plain chunks; None leaves every chunk to the library.
    ``blanks_count`` says whether blanks are part of the tokens (byte-level) or dropped (word-level, lower-cased);
    ``entries`` is the size of its cache of chunks."""

    def __init__(self, path: str, pattern: str | None, blanks_count: bool, entries: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        specials = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)").search
        self.pattern = regex.compile(pattern).findall if pattern else None
        self.blanks_count = blanks_count
        self.table = byte_table()
        self.blank = self.table[32]
        self.chunks = Cache(entries)
        self.short: dict[str, bytes] = {}
        self.tails = [b"", self._piece(","), self._piece(".")]

    def _piece(self, piece: str) -> bytes:
        if len(piece) > SHORT:
            return self._long_piece(piece)
        found = self.short.get(piece)
        if found is None:
            found = self._long_piece(piece)
            if len(self.short) < SHORT_ENTRIES:
                self.short[piece] = found
        return found

    def _long_piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            piece = piece.replace(" ", self.blank)
        else:
            piece = piece.encode().decode("latin-1").translate(self.table)
        return self._ids(piece)

    def _ids(self, name: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(name)]).tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of any text by one call of the library."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _content(self, content: str) -> bytes:
        if not content:
            return b""
        if self.pattern is None or not PLAIN(content) or self.special(content):
            return self.whole(content)
        plain = content if self.blanks_count else content.lower()
        word = plain[1:] if plain[0] == " " else plain
        if word.isalpha():
            return self._piece(plain)
        return b"".join([self._piece(p) for p in self.pattern(plain)])

    def _chunk(self, key: str) -> bytes:
        """Ids of a chunk, ``UNSAFE`` if its ends don't allow to cut there.  A chunk after a blank comes without it; one of
        blanks and a word that stays with them comes after an own mark."""
        if key.isascii() and key.isalpha():  # most are
            return self._ids(self.blank + key if self.blanks_count else key.lower())
        if key.startswith(RUN):
            return self._content(key[1:])
        if not self.blanks_count:
            return self._content(key.removeprefix(FIRST).removeprefix("\n"))
        first = key.startswith(FIRST)
        body = key[1:] if first or key.startswith("\n") else key
        if not body:
            return b"" if first else UNSAFE
        if body[-1].isspace():
            return UNSAFE
        return self._content(body if first else ("\n" if key[0] == "\n" else " ") + body)

    def _runs(self, text: str) -> bytes:
        """A text with runs of blanks: each run stays with the word after it."""
        runs = RUNS(text)
        if any(run[-1].isspace() and (i + 1 < len(runs) or run.strip(" \n")) for i, run in enumerate(runs)):
            return self.whole(text)
        return b"".join(self.chunks.values([RUN + run for run in runs], self._chunk))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one entry more than texts)."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, "[\x00\x01]").to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()),
                                             pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(marked, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        tailed = pc.match_substring_regex(coded.dictionary, TAIL)
        tails = (tailed.cast(pa.int8()).to_numpy() * (1 + pc.ends_with(coded.dictionary, ".").cast(pa.int8()).to_numpy())).tolist()
        bare = pc.if_else(tailed, pc.utf8_slice_codeunits(coded.dictionary, 0, -1), coded.dictionary).dictionary_encode()
        found = self.chunks.values(bare.dictionary.to_numpy(zero_copy_only=False).tolist(), self._chunk)
        values = [found[c] + self.tails[t] if t else found[c] for c, t in zip(bare.indices.to_numpy().tolist(), tails, strict=True)]
        unsafe = np.array([v is UNSAFE for v in values])
        for i in np.flatnonzero(unsafe):
            values[i] = b""
        whole = odd | (np.add.reduceat(unsafe[index].astype(np.int64), bounds[:-1]) > 0)
        if whole.any():
            empty = len(values)
            values.append(b"")
            for i in np.flatnonzero(whole):
                text = texts[i].as_py()
                index[bounds[i]:bounds[i + 1]] = empty
                index[bounds[i]] = len(values)
                values.append(self.whole(text) if odd[i] else self._runs(text))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool = np.frombuffer(b"".join(values), "<u4")
        begin = np.cumsum(sizes) - sizes
        taken = sizes[index]
        ends = np.cumsum(taken)
        ids = pool[np.repeat(begin[index] - (ends - taken), taken) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends[bounds[1:] - 1]])


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, pattern: str | None, blanks_count: bool, entries: int | None = None) -> ChunkEncoder:
    """The worker's encoder for these parameters; its bounded cache outlives a task."""
    key = (path, pattern, blanks_count, entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
