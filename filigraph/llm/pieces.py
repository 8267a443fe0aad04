"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each text falls into units that no merge can cross. Within a unit an agenda of adjacent symbol
pairs, ordered by score and then from the left, is worked off until no pair makes a piece. Units of
one length run through their agendas together in arrays; every new unit of an Arrow batch is
checked against the sentencepiece library before its result is used.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from filigraph.llm.shared import text_or_empty

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_NORMAL, _UNUSED, _BYTE, _CONTROL = 1, 5, 6, 3


class PieceModel:
    """A merge-type vocabulary with byte fallback and the identity normaliser."""

    def __init__(self, path: str, cache_units: int = 300_000, check: bool = True):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trainer, rule = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != 2 or not trainer.byte_fallback or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or trainer.treat_whitespace_as_suffix or kinds - {1, 2, 3, 5, 6}:
            raise ValueError("only merge-type vocabularies with byte fallback, the identity normaliser and no own symbols are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check, self.cache_units, self.eos = check, cache_units, self.library.eos_id()
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        usable = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (_NORMAL, _UNUSED)}
        if any(SPACE in p.lstrip(SPACE) for p in usable):
            raise ValueError("a piece holds a space inside; units can't be told apart")
        longer = "".join(p for p in usable if len(p) > 1)
        newline = "" if "\n" in longer else "\n"
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+" + ("|\n" if newline else ""))
        self._pairs(usable, proto)
        self.cache: dict[str, tuple[str, str]] = {}

    def _pairs(self, usable: dict[str, int], proto) -> None:
        """Symbols are pieces and the characters in them; the table has every pair whose join is a piece."""
        self.symbols = dict(usable)
        for c in sorted({c for p in usable for c in p} - set(usable)):
            self.symbols[c] = len(self.pieces) + len(self.symbols)
        levels = {s: k for k, s in enumerate(sorted({proto.pieces[i].score for i in usable.values()}, reverse=True))}
        found = {}
        for piece, i in usable.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = (levels[proto.pieces[i].score], i)
        self.pair = found
        self.keys = np.array(sorted(found), np.int64)
        values = np.array([found[k] for k in self.keys.tolist()], np.int32).reshape(-1, 2)
        self.rank_of, self.merged_of = values[:, 0].copy(), values[:, 1].copy()
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        self.char_of = {i: s for s, i in self.symbols.items() if len(s) == 1}
        self.plain = [p.replace(SPACE, " ") if k in (_NORMAL, _UNUSED) else None for p, k in zip(self.pieces, self.types)]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.first_foreign = 1 << 24  # symbols from here on are characters outside the vocabulary

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank_of[at], _NONE), np.where(hit, self.merged_of[at], 0)

    def units(self, text: str) -> list[str]:
        """The units of a text, spaces written as in the vocabulary, with the leading dummy space."""
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _agenda(self, units: list[str]) -> list[list[int]]:
        """The ids of units of one length. In each round every unit takes the next pair of its agenda."""
        n, width = len(units), len(units[0])
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(n, width)
        symbol = self.symbol_of[code]
        symbol = np.where(symbol < 0, code + self.first_foreign, symbol)
        alive = np.ones((n, width), bool)
        if width > 1:
            rank, merged = self._look_up(symbol[:, :-1], symbol[:, 1:])
            rank = np.concatenate([rank, np.full((n, 1), _NONE)], axis=1)
            merged = np.concatenate([merged, np.zeros((n, 1), merged.dtype)], axis=1)
            after = np.tile(np.arange(1, width + 1), (n, 1))
            before = np.tile(np.arange(-1, width - 1), (n, 1))
            rows = np.arange(n)
            while True:
                at = rank[rows].argmin(axis=1)
                busy = rank[rows, at] < _NONE
                rows, at = rows[busy], at[busy]
                if not len(rows):
                    break
                gone = after[rows, at]
                symbol[rows, at] = merged[rows, at]
                alive[rows, gone] = False
                rank[rows, gone] = _NONE
                beyond = after[rows, gone]
                after[rows, at] = beyond
                inner = beyond < width
                before[rows[inner], beyond[inner]] = at[inner]
                rank[rows, at] = _NONE
                r, a, b = rows[inner], at[inner], beyond[inner]
                rank[r, a], merged[r, a] = self._look_up(symbol[r, a], symbol[r, b])
                ahead = before[rows, at]
                inner = ahead >= 0
                r, a, b = rows[inner], ahead[inner], at[inner]
                rank[r, a], merged[r, a] = self._look_up(symbol[r, a], symbol[r, b])
        left = symbol[alive]
        flat, ends = left.tolist(), np.cumsum(alive.sum(1)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        return out if left.max() < len(self.pieces) else [self._ids(s) for s in out]

    def _long_agenda(self, unit: str) -> list[int]:
        """The same agenda as a heap, for units of any length in n log n steps."""
        symbol = [int(self.symbol_of[ord(c)]) if self.symbol_of[ord(c)] >= 0 else ord(c) + self.first_foreign for c in unit]
        after, before = [*range(1, len(symbol)), -1], [*range(-1, len(symbol) - 1)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.pair.get(symbol[a] << 32 | symbol[b])):
                heapq.heappush(agenda, (found[0], a, symbol[a], symbol[b], found[1]))

        for i in range(len(symbol) - 1):
            propose(i, i + 1)
        while agenda:
            _, a, left, right, piece = heapq.heappop(agenda)
            b = after[a]
            if symbol[a] != left or b < 0 or symbol[b] != right:
                continue
            symbol[a], symbol[b], after[a] = piece, -1, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            propose(before[a], a)
            propose(a, after[a])
        return [s for s in symbol if s >= 0]

    def _ids(self, symbols: list[int]) -> list[int]:
        """Piece ids; what is outside the vocabulary becomes the ids of its UTF-8 bytes."""
        if max(symbols) < len(self.pieces):
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < len(self.pieces):
                out.append(s)
            else:
                c = chr(s - self.first_foreign) if s >= self.first_foreign else self.char_of[s]
                out += [self.byte_ids[x] for x in c.encode()]
        return out

    def encode_units(self, units: Iterable[str], short: int = 40) -> dict[str, list[int]]:
        """Ids of distinct units."""
        by_length: dict[int, list[str]] = {}
        for unit in units:
            by_length.setdefault(len(unit) if len(unit) <= short else 0, []).append(unit)
        out = {u: self._ids(self._long_agenda(u)) for u in by_length.pop(0, [])}
        for same in by_length.values():
            out.update(zip(same, self._agenda(same)))
        return out

    def surface(self, ids: list[int]) -> str:
        """What ids stand for, spaces in front included; ill-formed bytes become one replacement character each."""
        parts = [self.plain[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, data = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                data.append(self.byte_of[i])
                continue
            while data:
                for k in range(min(4, len(data)), 0, -1):
                    try:
                        out.append(bytes(data[:k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                del data[:k]
            if i >= 0 and self.types[i] not in (_CONTROL,):
                out.append(" ⁇ " if self.types[i] == 2 else self.pieces[i])
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy space in front."""
        text = self.surface(ids)
        first = next((i for i in ids if self.types[i] != _CONTROL), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without an end id."""
        units = self.units(text)
        found = self.encode_units(set(units))
        return [i for u in units for i in found[u]]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The units of each text, all of them in the cache with ids and surface.

        A full cache keeps its older half, where the frequent units are.
        """
        split = [self.units(t) for t in texts]
        used = set().union(*split)
        fresh = used - self.cache.keys()
        if len(self.cache) + len(fresh) > self.cache_units:
            self.cache = dict(islice(self.cache.items(), self.cache_units // 2))
            fresh = used - self.cache.keys()
        found = self.encode_units(fresh)
        surfaces = {unit: self.surface(ids) for unit, ids in found.items()}
        if self.check and found:
            self._compare(found, surfaces)
        names = self.names
        for unit, ids in found.items():
            self.cache[unit] = " ".join([names[i] for i in ids]), surfaces[unit]
        return split

    def _compare(self, found: dict[str, list[int]], surfaces: dict[str, str]) -> None:
        """Holds new units against the library. A unit without its own space in front is encoded behind a line feed."""
        spaced = [u for u in found if u[0] == SPACE and len(u) > 1]
        others = [u for u in found if u[0] != SPACE]
        before = self.library.encode("\n", num_threads=1)
        own = [found[u] for u in spaced] + [before + found[u] for u in others]
        theirs = self.library.encode([u[1:] for u in spaced] + ["\n" + u for u in others], num_threads=1)
        if own != theirs:
            bad = next(u for u, a, b in zip(spaced + others, own, theirs) if a != b)
            raise AssertionError(f"the library encodes {bad!r} in another way")
        decoded = self.library.decode([i for ids in own for i in ids])
        mine = "".join([surfaces[u] for u in spaced] + [" \n" + surfaces[u] for u in others])
        if decoded != mine[1:]:
            raise AssertionError("the library decodes a unit in another way")

    def coded(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(decimal ids joined by spaces with the end id, decoded text) of each text."""
        collects = gc.isenabled()
        gc.disable()  # millions of short lists without cycles
        try:
            split = self.learn(texts)
        finally:
            if collects:
                gc.enable()
        for units in split:
            entries = [self.cache[u] for u in units]
            ids = " ".join([e[0] for e in entries])
            yield f"{ids} {self.eos}" if ids else str(self.eos), "".join([e[1] for e in entries])[1:]


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """This process's model for a vocabulary file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _blocks(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _map(docs: DataFrame, id_col: str, text_col: str, schema: str, kinds: list, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                out = [x for block in _blocks(batch.column(1).to_pylist()) for x in row(block)]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each whole text, with an end id. A null or empty text has the end id only."""
    return _map(docs, id_col, text_col, "doc_id long, ids array<int>", [pa.list_(pa.int32())], lambda block: [([int(i) for i in ids.split()],) for ids, _ in model_at(path).coded(block)])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each whole text encoded with an end id, and decoded again.

    One row per input row. A null or empty text has the end id only and decodes to the empty text.
    """

    def digests(block: list[str]) -> Iterator[tuple[int, str, str]]:
        for ids, decoded in model_at(path).coded(block):
            yield ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _map(docs, id_col, text_col, schema, [pa.int64(), pa.string(), pa.string()], digests)
