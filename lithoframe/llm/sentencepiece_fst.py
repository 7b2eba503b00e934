"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three transducers. The normaliser maps a text by the longest rules of the model's character map, squeezes and
escapes spaces and puts one in front. The lexicon is a trie of all pieces as sorted arcs (state, character) -> state, whose final states give out a piece
at its weight. Byte fallback has an arc for each character that the lexicon lacks. Composed with a text they give a lattice, of which the path
that is shortest in the tropical semiring (weights add up along a path, the least sum wins) is taken.

Weights of a unigram model are the pieces' negative log probabilities. For a BPE model the lattice's states are (position, last piece) and
the weight of a piece after a piece is 0 if merging leaves just these two of their joint text, else infinite, and that of a first piece is 0 if
merging makes it at all; a sequence is what merging gives if and only if all its neighbours are, so exactly one path is finite.

Where two characters stand side by side in no piece, no piece crosses, so the lattice falls apart there into words that are solved by themselves. All words of some hundred texts
are cut, numbered and put together again as columns, and new ones are solved at once: arcs of all their positions come from one walk through the sorted arcs, and a step of the
shortest path is taken at the same offset of all words.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.llm.common import list_array, with_field

SPACE = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class CharMap:
    """The longest rule of a model's character map at a place of a text. The map is a double array over UTF-8 bytes, and the strings that its leaves point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units, self.strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]

    def _rule(self, raw: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement), (0, 0) without a rule."""
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node, found = offset(self.units[0]), (0, 0)
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = self.units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        return found

    def __call__(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "replace"), bytearray(), 0
        while at < len(raw):
            n, place = self._rule(raw, at)
            if n:
                out += self.strings[place : self.strings.index(b"\0", place)]
                at += n
            else:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                out += raw[at : at + n]
                at += n
        return out.decode("utf-8", "replace")


class Machine:
    """A compiled model. Solved words are kept, `most_words` of them and as many pairs of pieces as `most_pairs`.

    Words are the bytes of their code points (UTF-32) and lead to the bytes of their ids. They are kept in two halves: when the newer one is full it
    becomes the older one, from which words that come up again move back.
    """

    #: Words up to this length are solved together, longer ones each by itself.
    TOGETHER = 48
    #: Words that are solved at once: their lattices are some kB each.
    AT_ONCE = 6_000
    #: Characters that are told apart where texts are cut; rarer ones of the pieces share one group, which only leaves words longer.
    GROUPS = 1023

    def __init__(self, model: bytes, most_words: int = 150_000, most_pairs: int = 400_000):
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes, self.unknown = [-1] * 256, 0
        kinds, self.prefix, self.squeeze, kind, self.map, user, fallback = [], True, True, 1, None, [], 0
        for number, value in fields(model):
            if number == 1:
                got = dict(fields(value))
                piece, score, what = got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)
                if what == BYTE:
                    self.bytes[int(piece[3:5], 16)] = len(kinds)
                elif what == UNKNOWN:
                    self.unknown = len(kinds)
                elif what in (NORMAL, USER):
                    self.score[piece], self.id[piece] = score, len(kinds)
                    if what == USER:
                        user.append(piece)
                self.pieces.append(piece)
                kinds.append(what)
            elif number == 2:
                trainer = dict(fields(value))
                kind, fallback = trainer.get(3, 1), trainer.get(35, 0)
                if trainer.get(24):
                    raise ValueError("models that put spaces after words are not supported")
            elif number == 3:
                spec = dict(fields(value))
                self.map = CharMap(spec[2]) if spec.get(2) else None
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1):
                    raise ValueError("only models that escape spaces are supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if kind == 2 and UNUSED in kinds:
            raise ValueError("BPE models with unused pieces are not supported")
        self.unigram, self.fallback = kind == 1, bool(fallback)
        self.user = re.compile("|".join(re.escape(p) for p in sorted(user, key=len, reverse=True))) if user else None
        self.said = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.spoken = pa.array(self.said, pa.large_binary())
        self._compile([p for p in self.score if p not in set(user)] if kind == 2 else list(self.score), set(user))
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.most_words, self.most_pairs = most_words, most_pairs

    def _compile(self, pieces: list[str], user: set[str]) -> None:
        """The lexicon's arcs, once for a look-up of one arc and once sorted for many; final states; neighbours within pieces; weights."""
        self.arcs: dict[int, int] = {}
        final = [-1]
        for p in pieces:
            state = 0
            for c in map(ord, p):
                key = state << 21 | c
                if key not in self.arcs:
                    self.arcs[key] = len(final)
                    final.append(-1)
                state = self.arcs[key]
            final[state] = self.id[p]
        keys = np.fromiter(self.arcs, np.int64, len(self.arcs))
        order = np.argsort(keys)
        self.arc_keys, self.arc_ends = keys[order], np.fromiter(self.arcs.values(), np.int64, len(keys))[order]
        self.final, self.finals = np.array(final, np.int64), final
        pairs = {x for p in pieces for x in zip(p, p[1:])}
        groups = {c: min(k, self.GROUPS) for k, (c, _) in enumerate(Counter(c for x in sorted(pairs) for c in x).most_common(), 1)}
        self.group = np.zeros(0x110000, np.int32)
        self.group[[ord(c) for c in groups]] = list(groups.values())
        self.joined = np.zeros((self.GROUPS + 1) ** 2, bool)
        self.joined[[groups[a] * (self.GROUPS + 1) + groups[b] for a, b in pairs]] = True
        scores = [s for p, s in self.score.items() if p not in user] or [0.0]
        # Fixed values of the format: what an unknown character costs, and what a user-defined piece gains.
        self.unknown_weight = -(min(scores) - 10.0)
        weight = {p: -s for p, s in self.score.items()} | {p: -(len(p.encode()) * max(scores) - 0.1) for p in user}
        self.weights = [0.0] * len(self.pieces)
        for p, w in weight.items():
            self.weights[self.id[p]] = w
        self.weight = np.array(self.weights)

    def normalise(self, text: str) -> str:
        """The first transducer. User-defined pieces pass as they are."""
        if self.map:
            text = "".join(x if k % 2 else self.map(x) for k, x in enumerate(re.split(f"({self.user.pattern})", text))) if self.user else self.map(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return ((" " if self.prefix else "") + text).replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours are joined first, the leftmost of equals."""
        symbols = list(text)
        after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (both := symbols[i] + symbols[after[i]]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j], after[i] = both, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def _name(self, symbol: int) -> str:
        """A piece, or the character that is none: symbols from len(pieces) on are characters."""
        return self.pieces[symbol] if symbol < len(self.pieces) else chr(symbol - len(self.pieces))

    def follows(self, pair: int) -> bool:
        """Whether the weight of a piece after a piece is finite in a BPE model; below 0, of a piece that is first."""
        if (known := self.pairs.get(pair)) is None:
            last, piece = self._name(pair >> 32) if pair >= 0 else "", self._name(pair & 0xFFFFFFFF)
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return known

    def emit(self, path: list[int]) -> tuple[int, ...]:
        """Ids of the symbols on a path: byte fallback turns characters that are no piece into bytes; without it a run of them is one unknown."""
        n, out = len(self.pieces), []
        for symbol in path:
            if symbol < n:
                out.append(symbol)
            elif self.fallback and min(ids := [self.bytes[b] for b in chr(symbol - n).encode("utf-8", "replace")]) >= 0:
                out += ids
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def shortest_path(self, word: str) -> list[int]:
        """The symbols on the shortest path through the lattice of one word, left to right."""
        n, chars = len(word), [ord(c) for c in word]
        best, last, start = [np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0], last[0] = 0.0, -2
        unigram, arcs, finals, size = self.unigram, self.arcs, self.finals, len(self.pieces)
        for i in range(n):
            if last[i] == -1:
                continue
            state, at, single = 0, i, False
            while at < n and (state := arcs.get(state << 21 | chars[at])) is not None:
                at += 1
                if (piece := finals[state]) < 0:
                    continue
                single = single or at == i + 1
                if unigram:
                    if (w := best[i] + self.weights[piece]) < best[at]:
                        best[at], last[at], start[at] = w, piece, i
                elif last[at] < 0 and self.follows(last[i] << 32 | piece):
                    last[at], start[at] = piece, i
            if not single:
                symbol = size + chars[i]
                if unigram:
                    if (w := best[i] + self.unknown_weight) < best[i + 1]:
                        best[i + 1], last[i + 1], start[i + 1] = w, symbol, i
                elif last[i + 1] < 0 and self.follows(last[i] << 32 | symbol):
                    last[i + 1], start[i + 1] = symbol, i
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def shortest_paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """shortest_path() of many short words, none of them empty, one after the other, and the number of symbols of each."""
        sizes = np.array([len(w) for w in words]) // 4
        chars = np.frombuffer(b"".join(words), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        place = np.arange(len(chars)) - np.repeat(begins, sizes)  # offset of each character in its word
        left = np.repeat(sizes, sizes) - place  # characters from it to the end of its word
        # Arcs of the lexicon from all positions at once, by their lengths.
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, state, k = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            key = state << 21 | chars[at + k]
            spot = np.searchsorted(self.arc_keys, key)
            spot[spot == len(self.arc_keys)] = 0
            live = self.arc_keys[spot] == key
            at, state = at[live], self.arc_ends[spot[live]]
            piece = self.final[state]
            hit = piece >= 0
            if k == 0:
                alone = np.full(len(chars), -1, np.int64)
                alone[at[hit]] = piece[hit]
                found.append((np.arange(len(chars)), np.where(alone >= 0, alone, len(self.pieces) + chars)))
            else:
                found.append((at[hit], piece[hit]))
            k += 1
            more = left[at] > k
            at, state = at[more], state[more]
        # nodes: one more than characters for each word
        node = np.arange(len(chars)) + np.repeat(np.arange(len(words)), sizes)
        total = len(chars) + len(words)
        last, start, best = np.full(total, -1, np.int64), np.zeros(total, np.int64), np.full(total, np.inf)
        first = begins + np.arange(len(words))
        best[first], last[first] = 0.0, -2
        steps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n, (where, piece) in enumerate(found):
            if not len(where):
                continue
            order = np.argsort(place[where], kind="stable")
            offsets, cut = np.unique(place[where][order], return_index=True)
            for o, rows in zip(offsets.tolist(), np.split(order, cut[1:]), strict=True):
                steps[o, n + 1] = (node[where[rows]], piece[rows])
        for o, n in sorted(steps):
            src, piece = steps[o, n]
            dst = src + n
            if self.unigram:
                w = best[src] + np.where(piece < len(self.pieces), self.weight[np.minimum(piece, len(self.pieces) - 1)], self.unknown_weight)
                good = w < best[dst]
                best[dst[good]] = w[good]
            else:
                good = (last[src] != -1) & (last[dst] == -1)
                src, dst, piece = src[good], dst[good], piece[good]
                pair, back = np.unique(last[src] << 32 | piece, return_inverse=True)
                follows, known = self.follows, self.pairs.get
                ok = [x if (x := known(q)) is not None else follows(q) for q in pair.tolist()]
                good = np.array(ok, bool)[back] if ok else np.zeros(0, bool)
            last[dst[good]], start[dst[good]] = piece[good], src[good]
        # All paths are read from their ends at once.
        at, path = ends + np.arange(len(words)), []
        while (open_ := at > first).any():
            path.append(np.where(open_, last[at], -1))
            at = np.where(open_, start[at], at)
        table = np.array(path[::-1]).T
        taken = table >= 0
        return table[taken], taken.sum(axis=1)

    def solve(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of these words, which are all different."""
        short, out = [w for w in words if len(w) <= 4 * self.TOGETHER], {}
        for at in range(0, len(short), self.AT_ONCE):
            some = short[at : at + self.AT_ONCE]
            path, sizes = self.shortest_paths(some)
            ends = np.cumsum(sizes)
            raw, odd = path.astype("<i4").tobytes(), np.add.reduceat(path >= len(self.pieces), ends - sizes) > 0
            out.update((w, raw[4 * (b - n) : 4 * b]) for w, b, n in zip(some, ends.tolist(), sizes.tolist(), strict=True))
            for k in np.flatnonzero(odd).tolist():
                out[some[k]] = np.array(self.emit(path[ends[k] - sizes[k] : ends[k]].tolist()), "<i4").tobytes()
        for w in words:
            if len(w) > 4 * self.TOGETHER:
                out[w] = np.array(self.emit(self.shortest_path(w.decode("utf-32-le", "surrogatepass"))), "<i4").tobytes()
        return out

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of these words, which are all different; new ones are solved and kept."""
        ids = list(map(self.words.get, words))
        missing = [w for w, i in zip(words, ids, strict=True) if i is None]
        again = {w: self.older[w] for w in missing if w in self.older}
        again |= self.solve([w for w in missing if w not in again])
        if len(self.words) + len(again) > self.most_words // 2:
            self.words, self.older = {}, self.words
        self.words |= again
        return [again[w] if i is None else i for w, i in zip(words, ids, strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; empty for null and empty texts."""
        normal = [self.normalise(t or "") for t in texts]
        raw, ends = "".join(normal).encode("utf-32-le", "surrogatepass"), np.cumsum([0, *map(len, normal)])
        group = self.group[np.frombuffer(raw, np.uint32)]
        cut = np.ones(len(group) + 1, bool)
        cut[1:-1] = ~self.joined[group[:-1] * (self.GROUPS + 1) + group[1:]]
        cut[ends] = True
        own = {}
        if self.user and not self.unigram:  # merging stops at user-defined pieces
            for text, at in zip(normal, ends.tolist()):
                for x in self.user.finditer(text):
                    cut[at + x.start() + 1 : at + x.end()] = False
                    cut[[at + x.start(), at + x.end()]] = True
                    own[x[0].encode("utf-32-le", "surrogatepass")] = np.array([self.id[x[0]]], "<i4").tobytes()
        places = np.flatnonzero(cut)
        if len(places) == 1:
            return [np.zeros(0, np.int32) for _ in texts]
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(4 * places.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        words = parts.dictionary.to_pylist()
        known = dict(zip(rest := [w for w in words if w not in own], self.ids_of(rest), strict=True)) | own if own else None
        ids = pa.array([known[w] for w in words] if own else self.ids_of(words), pa.large_binary()).take(parts.indices)
        flat, stops = np.frombuffer(ids.buffers()[2], "<i4"), np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(places, ends)] // 4
        if not self.fallback:  # a run of unknowns over several words is one
            unknown = flat == self.unknown
            keep = np.append(True, ~(unknown[1:] & unknown[:-1]))
            keep[stops[stops < len(flat)]] = True
            flat, stops = flat[keep], np.append(0, np.cumsum(keep))[stops]
        return [flat[a:b] for a, b in zip(stops.tolist(), stops[1:].tolist())]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The texts that these ids stand for."""
        said = self.spoken.take(pa.array(np.concatenate(ids))) if ids else self.spoken[:0]
        stops = np.frombuffer(said.buffers()[1], np.int64)[np.cumsum([0, *map(len, ids)])].tolist() if len(said) else [0] * (len(ids) + 1)
        raw = memoryview(said.buffers()[2] or b"")
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(stops, stops[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.prefix else texts

    def decode(self, ids) -> str:
        return self.decode_all([np.array(ids, np.int64)])[0]


def chunks(batch: pa.RecordBatch, at: int, most_rows: int = 400, most_bytes: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch whose texts (column `at`) are solved together, and these texts. Only one slice's texts are Python strings at a time."""
    column = batch.column(at)
    column = column.cast(pa.string()) if pa.types.is_null(column.type) else column
    ends, a = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)), 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = min(max(a + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), a + most_rows, len(ends))
        part = batch.slice(a, b - a)
        yield part, part.column(at).to_pylist()
        a = b


@lru_cache(2)
def machine(model: bytes) -> Machine:
    """The model's machine, compiled once in each Python worker."""
    return Machine(model)


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column `out` of piece ids; empty for null and empty texts. Other columns pass through; one of that name is replaced."""
    docs = docs.drop(out)
    at = docs.columns.index(text)

    def run(batches):
        m = machine(model)
        for whole in batches:
            for batch, texts in chunks(whole, at):
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(m.encode_all(texts), pa.int32())], [*batch.schema.names, out])

    return docs.mapInArrow(run, with_field(docs, out, T.ArrayType(T.IntegerType())))


def encode_checked(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with ids, and with round_trip: whether decoding them gives the text back. The text column goes; the others pass through. One pass in one Python worker a task."""
    docs = docs.drop("ids", "round_trip")
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        m = machine(model)
        for whole in batches:
            for batch, texts in chunks(whole, len(kept)):
                ids = m.encode_all(texts)
                same = [back == (t or "") for back, t in zip(m.decode_all(ids), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], list_array(ids, pa.int32()), pa.array(same, pa.bool_())], [*kept, "ids", "round_trip"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """docs with a column `out` of the text that the ids in `ids` stand for; empty for null. Other columns pass through; one of that name is replaced."""
    docs = docs.drop(out)
    at = docs.columns.index(ids)

    def run(batches):
        m = machine(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(run, with_field(docs, out, T.StringType()))


def coded(docs: DataFrame, model: bytes) -> DataFrame:
    """documents -> doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip.

    Null and empty texts have no pieces. A text that holds U+2581 itself comes back with spaces in its place. Repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        m = machine(model)
        for whole in batches:
            for batch, texts in chunks(whole, 1):
                every, rows = m.encode_all(texts), []
                for text, ids, back in zip(texts, every, m.decode_all(every), strict=True):
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
