"""SentencePiece BPE encoding by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import map_rows

#: The model's mark of a space. Here pieces and texts hold the space itself: the two are one to the model.
MARK = "▁"
#: Encoded segments and pairs that a task remembers; at the limit it starts afresh.
REMEMBERED = 250_000
#: Longer segments are encoded each time they occur.
MEMORABLE = 48


class Model:
    """The vocabulary of a merge-type model: pieces, their priorities and the byte pieces."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)  # reads the file; encodes nothing
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.piece: list[str] = [library.id_to_piece(i).replace(MARK, " ") for i in range(library.get_piece_size())]
        self.normal: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        #: What an id adds to a decoded text, in UTF-8.
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(self.piece):
            if library.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(p[1:-1], 16)]))
            elif library.is_control(i):
                self.bytes_of.append(b"")
            elif library.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.normal[p] = i
                self.bytes_of.append(p.encode())
        self.score = {p: library.get_score(i) for p, i in self.normal.items()}
        self.byte_ids = frozenset(self.byte.values())
        #: Tokens that merging can reach; no other may stand in an encoding.
        self.token: dict[str, int] = {p: i for p, i in self.normal.items() if self.merge(p) == [p]}
        self.longest = ahocorasick.Automaton()
        #: The next shorter token that a token starts with, and the two tokens it is made from.
        self.shorter: dict[int, tuple[int, int]] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for p, i in self.token.items():
            self.longest.add_word(p, (len(p), i))
            width = next((w for w in range(len(p) - 1, 0, -1) if p[:w] in self.token), 0)
            if width:
                self.shorter[i] = (width, self.token[p[:width]])
            if len(p) > 1:
                self.halves[p] = tuple(self.merge(p, stop=2))
        self.longest.make_automaton()
        self._fits: dict[int, bool] = {}
        self.segments = re.compile(self._segment_pattern()).findall

    def _segment_pattern(self) -> str:
        """Cuts a text where no token can lie across: in front of a run of spaces, around
        characters that stand in no longer token, and between a letter and a character
        that follows a letter in no token. Short segments recur, so they can be remembered."""
        long = [p for p in self.token if len(p) > 1]
        if any(" " in p.lstrip(" ") for p in long):
            return r"(?s:.+)"
        inner = {c for p in long for c in p} - {" "}
        letters = {c for c in inner if c.isalpha()}
        after = {b for p in long for a, b in zip(p, p[1:]) if a in letters}
        every, letter, other, joint = (
            "".join(re.escape(c) for c in sorted(x)) for x in (inner, letters, inner - letters, (inner - letters) & after))
        tail = f"(?:[{joint}][{every}]*)?" if joint else ""
        return f" +(?:[{other}][{every}]*|[{letter}]*{tail})|[{letter}]+{tail}|[{other}][{every}]*|[^ {every}]"

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """The defining rule: join the neighbours whose union is the best piece, leftmost first."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Does merging the text of two tokens give the two again?

        The merges are taken back, the latest first. While both neighbours of the
        border stand, their union must not be a piece that would have been made
        before the merge just taken back; at equal priority the left one is first.
        """
        score, halves = self.score, self.halves
        union = score.get(left + right)
        while union is None:
            a, b = (score[x] if len(x) > 1 else None for x in (left, right))
            if a is None and b is None:
                return True
            if b is None or (a is not None and a < b):
                left = halves[left][1]
                union = score.get(left + right)
                if union is not None and union <= a:
                    union = None
            else:
                right = halves[right][0]
                union = score.get(left + right)
                if union is not None and union < b:
                    union = None
        return False

    def forget(self) -> None:
        self._fits.clear()

    def fits(self, left: int, right: int) -> bool:
        """``compatible`` for ids, remembered."""
        if len(self._fits) > REMEMBERED:
            self._fits.clear()
        known = self._fits[left * len(self.piece) + right] = self.compatible(self.piece[left], self.piece[right])
        return known

    def tokens(self, text: str) -> list[int]:
        """Token ids of a text whose characters are all tokens, by backtracking.

        At each place the longest token is tried first, then the shorter ones it
        starts with; one that does not fit its left neighbour is passed over. A
        place from which nothing fits is marked in a bit field and never entered
        again, so each place is left backwards once at most.
        """
        n = len(text)
        match: list[tuple[int, int] | None] = [None] * n
        for last, m in self.longest.iter(text):  # by their end, so the longest comes last
            match[last - m[0] + 1] = m
        path, widths, at, failed = [], [], 0, 0
        known, size, shorter = self._fits.get, len(self.piece), self.shorter.get
        while at < n:
            m = match[at]
            while m is not None:
                width, token = m
                m = shorter(token)
                if failed and failed >> (at + width) & 1:
                    continue
                if path:
                    good = known(path[-1] * size + token)
                    if not (self.fits(path[-1], token) if good is None else good):
                        continue
                match[at] = m
                path.append(token)
                widths.append(width)
                at += width
                break
            else:
                failed |= 1 << at
                if not path:
                    raise ValueError("no valid encoding: the model is not of the merge type")
                path.pop()
                at -= widths.pop()
        return path

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of a segment; characters that are no token become their bytes, or unknown."""
        if self.token.keys() >= set(segment):
            return self.tokens(segment)
        out: list[int] = []
        for known, run in groupby(segment, self.token.__contains__):
            if known:
                out += self.tokens("".join(run))
            elif self.byte:
                out += [self.byte[b] for b in "".join(run).encode()]
            else:
                out += [self.unknown]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end."""
        return [i for s in self.segments(" " + text.replace(MARK, " ")) for i in self.encode_segment(s)] if text else []

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that are no character become U+FFFD each."""
        parts = [self.bytes_of[i] for i in ids]
        joined = b"".join(parts)
        try:
            if b"" in parts[1:-1]:  # a control id, which ends a run of bytes
                joined = self._repaired(ids)
            joined.decode()
        except UnicodeDecodeError:
            joined = self._repaired(ids)
        first = next((i for i in ids if self.bytes_of[i]), None)
        return joined[1:] if first is not None and self.piece[first].startswith(" ") else joined

    def _repaired(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_ids:
                run += self.bytes_of[i]
                continue
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:width]).decode().encode())
                        del run[:width]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    del run[:1]
            if i is not None:
                out.append(self.bytes_of[i])
        return b"".join(out)


class Memory(dict):
    """Segment -> its ids as little-endian 32-bit integers; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        ids = self.model.encode_segment(segment)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(segment) <= MEMORABLE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = out
        return out


_LOADED: dict[str, Model] = {}


def loaded(path: str) -> Model:
    """One model for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def encode_text(memory: Memory, text: str) -> bytes:
    """Begin, the ids of the text, end: packed."""
    model = memory.model
    body = b"".join(map(memory.__getitem__, model.segments(" " + text.replace(MARK, " ")))) if text else b""
    return struct.pack("<I", model.begin) + body + struct.pack("<I", model.end)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and give the digests of both.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the
    ids themselves and the decoded text. One pass in batches, nothing shuffled.
    Defined cases: null is the empty text, which is begin and end and decodes to
    the empty text; repeated rows give repeated results; other columns are not
    read. A worker holds one batch, the vocabulary and a bounded memory of segments.
    """
    columns = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    columns |= {"ids": "array<int>", "decoded": "string"} if ids else {}

    def begin() -> Memory:
        memory = Memory(loaded(path))  # for this task: a worker keeps none of it for others
        memory.model.forget()
        return memory

    def run(memory: Memory, keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            packed = encode_text(memory, t or "")
            own = memoryview(packed).cast("I").tolist()
            back = memory.model.decode(own)
            row = (k, len(own), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
            yield (*row, own, back.decode()) if ids else row

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, 200, begin, **columns)
