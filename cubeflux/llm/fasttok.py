"""Tokenizer encoding by distinct chunk.

A tokenizers model is applied to each distinct chunk of a batch once; Arrow's dictionary encoding finds the distinct
chunks and numpy gathers their ids back. Chunks are cut where the tokenizer's own pre-tokenizer always cuts, so the
ids equal those of encoding the whole text. Texts that hold a special token's string or white space beyond ASCII are
encoded whole by the library.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from .common import column_bytes, ranges

_BYTE = "byte"
_WORD = "word"
#: Fixed patterns of the two public vocabularies' pre-tokenizers.
_PATTERNS = {
    _BYTE: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    _WORD: r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}

#: Of each byte: white space, a letter, a digit, another sign, or one that keeps its chunk whole.
_WHOLE = 4
_KINDS = np.full(256, 3, np.uint8)
_KINDS[:32] = _KINDS[128:] = _KINDS[ord("'")] = _WHOLE
_KINDS[[32, *range(9, 14)]] = 0
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[48:58] = 2


def _byte_alphabet() -> str:
    """Byte-level BPE's printable stand-in for each byte: printable Latin-1 is itself, the rest counts up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, memo: int = 200_000) -> ChunkEncoder:
    """The encoder of this process: a worker's tasks share its vocabulary and the chunks it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].limit = memo
    return _ENCODERS[path]


class ChunkEncoder:
    """memo: distinct chunks kept between batches; emptied when full, which costs time only."""

    def __init__(self, path: str, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), memo
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and not spec["normalizer"]
        clip = pre["type"] == "Sequence" and "</w>" == spec["model"].get("end_of_word_suffix")
        if not plain and not clip:
            raise ValueError("only the byte-level and the word-end BPE layouts are known here")
        self.kind = _BYTE if plain else _WORD
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.split = regex.compile(_PATTERNS[self.kind]).findall
        self.alphabet = _byte_alphabet()
        self.chunks: dict[bytes, bytes] = {}  # to ids as little-endian 32-bit integers
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
            got = self.pieces[piece] = [t.id for t in self.tok.model.tokenize(shown)]
        return got

    def _chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        if self.kind == _BYTE and (raw[1:] if raw[0] == 32 else raw).isalnum():  # letters or digits alone: one piece
            return array("I", [t.id for t in self.tok.model.tokenize(text.replace(" ", self.alphabet[32]))]).tobytes()
        if text.isascii() or max(text) < "Ā":  # no normalisation and no newer letters here
            ids = [i for p in self.split(text.lower() if self.kind == _WORD else text) for i in self._piece(p)]
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of an Arrow string array's rows, one after the other, and the rows' offsets."""
        import pyarrow as pa

        buf, offs = column_bytes(col)
        n = len(offs) - 1
        odd = self._odd(buf, offs)
        starts, ends = self._spans(buf, offs)
        keep = ~odd[np.searchsorted(offs, starts, side="right") - 1] if odd.any() else slice(None)
        starts, ends = starts[keep], ends[keep]
        flat, lens = np.empty(0, np.uint32), np.zeros(0, np.int64)
        if len(starts):
            # spans may leave gaps (white space): gather once, then the chunks are contiguous
            size = ends - starts
            joined = buf[ranges(starts, size)] if int(size.sum()) != len(buf) else buf
            bounds = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=bounds[1:])
            arr = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(joined))])
            coded = arr.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            if len(self.chunks) > self.limit:
                self.chunks.clear()
            if len(self.pieces) > self.limit:
                self.pieces.clear()
            memo, known = self.chunks, []
            for raw in coded.dictionary.to_pylist():
                got = memo.get(raw)
                if got is None:
                    got = memo[raw] = self._chunk(raw)
                known.append(got)
            own = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            first = np.cumsum(own) - own
            flat_known = np.frombuffer(b"".join(known), np.uint32)
            lens = own[index]
            flat = flat_known[ranges(first[index], lens)]
        row_of = np.searchsorted(offs, starts, side="right") - 1
        counts = np.bincount(row_of, weights=lens, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
        whole = {int(i): np.array(self.tok.encode(bytes(buf[offs[i] : offs[i + 1]]).decode(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(odd)}
        if whole:
            parts, at = [], 0
            for i in range(n):
                if i in whole:
                    parts.append(whole[i])
                else:
                    parts.append(flat[at : at + counts[i]])
                    at += counts[i]
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        out = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return flat, out

    def _odd(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        odd = np.zeros(len(offs) - 1, bool)
        if not len(buf):
            return odd
        raw = buf.tobytes()
        marks = [*self.special, b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
        for mark in marks:
            at = raw.find(mark)
            while at >= 0:
                row = int(np.searchsorted(offs, at, side="right")) - 1
                odd[row] = True
                at = raw.find(mark, int(offs[row + 1]))
        return odd

    def _spans(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(buf)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)  # the byte before is a solid one of the same row
        before[1:] = ~space[:-1]
        before &= ~edge[:-1]
        solid_after = np.zeros(n, bool)  # the byte after is a solid one of the same row
        solid_after[:-1] = ~space[1:]
        solid_after &= ~edge[1:]
        if self.kind == _WORD:
            starts = np.flatnonzero(~space & ~before)
            return starts, np.flatnonzero(~space & ~solid_after) + 1
        glued = space & (buf == 32) & solid_after  # a blank that goes with the word after it
        glued_before = np.zeros(n, bool)
        glued_before[1:] = glued[:-1]
        first_space = space & (before | edge[:-1])
        starts = glued | (~space & ~before & ~(glued_before & ~edge[:-1])) | first_space | (space & solid_after)
        starts |= edge[:-1]
        at = np.flatnonzero(starts)
        # letters, digits and other signs part, but in chunks with apostrophes, control characters or bytes beyond ASCII
        kind = _KINDS[buf]
        other = kind[1:] != kind[:-1]
        other &= buf[:-1] != 32
        starts[1:] |= other
        whole = np.unique(np.searchsorted(at, np.flatnonzero(kind == _WHOLE), side="right") - 1)
        if len(whole):
            inside = ranges(at[whole], np.append(at[1:], n)[whole] - at[whole])
            starts[inside] = False
            starts[at[whole]] = True
        at = np.flatnonzero(starts)
        return at, np.append(at[1:], n)
