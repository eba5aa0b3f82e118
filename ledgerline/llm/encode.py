"""Whole-text encoding with a public tokenizer file and a bounded piece cache."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters of Unicode's White_Space property.
WHITE = "\t-\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Beside single spaces and line ends; RE2 syntax.
_UNUSUAL = "[ \\n][ \\n]|[\\t\\x01\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_UNUSUAL_WORDS = "[\\x1c-\\x1f]"
_PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORD = re.compile(f"[^{WHITE}]+")
#: Bytes of text encoded in one step.
ENCODE_BYTES = 8 << 20
#: A byte that UTF-8 never has, and parts that are read with it between them.
GAP, JOINED = b"\xc0", 512
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Pieces of ASCII and Latin letters without an apostrophe: composed, and split alike by any Unicode version.
_COMMON = re.compile(f"[ \\n]?[{_LATIN}!-&(-~]*")
_WORD_PARTS = re.compile(f"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_BYTE_PARTS = re.compile(f" ?[{_LATIN}]+| ?[0-9]+| ?[^\\s{_LATIN}0-9]+|\\s")
#: _COMMON anchored, for RE2.
_COMMON_WHOLE = f"\\A{_COMMON.pattern}\\z"


def _byte_chars() -> dict[int, str]:
    """The usual printable stand-ins of byte-level tokenizers: printable Latin bytes are themselves, the rest follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _gathered(at: np.ndarray, size: np.ndarray, flat: np.ndarray, index: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of lists and their ids; index says which run of flat each value of the lists is."""
    index = index.to_numpy(zero_copy_only=False)
    each = size[index]
    ends = np.cumsum(each)
    ids = flat[np.repeat(at[index] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
    return np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()], ids


def _joined(raw: list[bytes], index: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    return _gathered(np.cumsum(size) - size, size, np.frombuffer(b"".join(raw), "<u4"), index, lists)


_BYTE_CHARS = _byte_chars()
_live: dict = {}


class Encoder:
    """ids of texts under one tokenizer file, as the library gives them for a whole text without special tokens added.

    Added tokens that a text spells out, such as an end mark, are one id each; with specials=False they are
    text like any other.

    Both tokenizer kinds here split at white space before merging, so a text is cut there, and common pieces
    again where letters, digits and signs meet: the library runs once for each new part. The caches hold at most
    `limit` parts and half as many other pieces; beyond that they are encoded again. Results equal encoding the whole text at once.
    """

    def __init__(self, path: str, limit: int = 700_000, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that strip, stand alone or are normalised are not known here")
        # texts are cut at added tokens first, the longest at each place; what is between is text
        self.added = {t.content: np.array([k], "<u4").tobytes() for k, t in added.items()} if specials else {}
        self.marks = "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))
        self.cut = re.compile(f"({self.marks})")
        self.tokenizer.encode_special_tokens = True
        self.limit = limit
        self.gap = self._gap()
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # word kind: white space yields no ids; byte kind: it belongs to the piece that follows
        self.words = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.unusual = _UNUSUAL_WORDS if self.words else _UNUSUAL

    @classmethod
    def at(cls, path: str, specials: bool = True) -> Encoder:
        """One encoder for each Python worker, so that its cache serves all of a worker's tasks."""
        if (path, specials) not in _live:
            _live[path, specials] = cls(path, specials=specials)
        return _live[path, specials]

    def _gap(self) -> int | None:
        """The id of GAP if it is never part of a longer token, so that what stands on either side is merged as if alone."""
        model, gap = self.tokenizer.model, _BYTE_CHARS[GAP[0]]
        if type(model).__name__ != "BPE" or model.dropout or model.ignore_merges or model.end_of_word_suffix or model.continuing_subword_prefix:
            return None
        return None if any(gap in t and t != gap for t in self.tokenizer.get_vocab(False)) else model.token_to_id(gap)

    def _one(self, text: str) -> bytes:
        """ids of a text with unusual white space or added tokens."""
        if not self.added:
            return b"".join(self._ids(self.pieces(text)))
        parts = self.cut.split(text)
        return b"".join([self.added[p] if k % 2 else b"".join(self._ids(self.pieces(p))) for k, p in enumerate(parts)])

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text with unusual white space."""
        return (_WORD if self.words else _PIECE).findall(text)

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """ids of pieces that are new here: common ones from their parts, others by the whole tokenizer."""
        out, parts = {}, {}
        for p in pieces:
            if _COMMON.fullmatch(p):
                parts[p] = (_WORD_PARTS if self.words else _BYTE_PARTS).findall(p.lower() if self.words else p)
            else:
                out[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        known = list({x for p in parts.values() for x in p})
        known = dict(zip(known, self._known(known), strict=True))
        for p, xs in parts.items():
            out[p] = b"".join([known[x] for x in xs])
        return out

    def _tokenized(self, parts: list[str]) -> dict[str, bytes]:
        """ids of new parts of common pieces; where no merge knows the byte GAP, parts with it between them are read in one call."""
        tokenize, out = self.tokenizer.model.tokenize, {}
        if self.gap is None:
            return {x: array("I", [t.id for t in tokenize(x.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes() for x in parts}
        for i in range(0, len(parts), JOINED):
            some = parts[i : i + JOINED]
            ids = np.array([t.id for t in tokenize(b"".join([x.encode() + GAP for x in some]).decode("latin-1").translate(_BYTE_CHARS))], "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.gap)).tolist()
            out |= zip(some, [data[a:b] for a, b in zip([0, *[x + 4 for x in ends[:-1]]], ends, strict=True)], strict=True)
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        """ids of distinct parts of common pieces."""
        return self._through(self.known, self.limit, parts, self._tokenized)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return self._through(self.cache, self.limit // 2, pieces, self._fresh)

    def _through(self, cache: dict[str, bytes], limit: int, pieces: list[str], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        found = list(map(cache.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if new:
            fresh = make(new)
            cache.update(islice(fresh.items(), max(0, limit - len(cache))))
            found = [fresh[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return found

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of each distinct piece's ids, and the ids; Arrow cuts common pieces and makes their parts distinct."""
        common = pc.match_substring_regex(pieces, _COMMON_WHOLE)
        plain = common.to_numpy(zero_copy_only=False)
        some = pieces.filter(common)
        marked = pc.replace_substring_regex(pc.utf8_lower(some) if self.words else some, f"({(_WORD_PARTS if self.words else _BYTE_PARTS).pattern})", "\\1\x01")
        lists = pc.split_pattern(marked, "\x01")
        parts = lists.flatten().dictionary_encode()
        bound, ids = _joined(self._known(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), parts.indices, lists)
        rest = self._ids(pieces.filter(pc.invert(common)).to_pylist())
        size = np.zeros(len(pieces), np.int64)
        size[plain], size[~plain] = np.diff(bound), [len(x) // 4 for x in rest]
        at = np.zeros(len(pieces), np.int64)
        for kind, first in ((plain, 0), (~plain, len(ids))):
            at[kind] = first + np.cumsum(size[kind]) - size[kind]
        return at, size, np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (n + 1) and ids (uint32) of an array of texts; null counts as empty.

        Texts whose white space is single spaces and line ends are split and made distinct by Arrow;
        others are cut by a pattern, with the same result.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.unusual)
        if self.added:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.marks))
        plain = pc.invert(odd).to_numpy(zero_copy_only=False)
        n = len(texts)
        sizes = np.zeros(n, np.int64)
        parts = []
        if plain.any():
            some = texts.filter(pa.array(plain))
            if self.words:
                lists = pc.utf8_split_whitespace(some)
            else:
                lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\x01", some, ""), "\n", " \n"), " ")
            coded = lists.flatten().dictionary_encode()
            kinds = coded.dictionary
            if not self.words:
                kinds = pc.binary_join_element_wise(" ", kinds, "")
                for first in ("\x01", "\n"):
                    kinds = pc.replace_substring(kinds, " " + first, first.strip("\x01"))
            bound, ids = _gathered(*self._coded(kinds), coded.indices, lists)
            sizes[plain] = np.diff(bound)
            if plain.all():
                return bound, ids
            parts.append((np.flatnonzero(plain), bound, ids))
        rest = np.flatnonzero(~plain)
        raw = [self._one(texts[int(k)].as_py()) for k in rest]
        sizes[rest] = [len(x) // 4 for x in raw]
        bound = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(bound[-1], "<u4")
        for k, x in zip(rest, raw, strict=True):
            out[bound[k] : bound[k + 1]] = np.frombuffer(x, "<u4")
        for where, b, ids in parts:
            for k, x, y in zip(where, b, b[1:], strict=False):
                out[bound[k] : bound[k + 1]] = ids[x:y]
        return bound, out
