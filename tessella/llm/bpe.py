"""SentencePiece BPE encoding and decoding, with seeded merge-dropout.

Encoding runs the agenda of SentencePiece's BPE models: of all adjacent symbols whose concatenation is a piece,
the best-scored (then leftmost) merges, until none is left; characters without a piece fall back to bytes. With
dropout every candidate that comes up is drawn, and with the chance alpha it is skipped for good; it can only come back
as a new candidate, when a neighbour has changed. The draws are hashes of the seed, the row (key, number of the copy,
text), the unit's number in the text and the draw's number, so each occurrence of a word is segmented on its own, and
everything repeats exactly. Skipped merges never change the text: decoding joins the pieces' bytes, and gives back
every text exactly.

Merges never cross into a blank from another character, nor from a letter into what isn't one (both are checked
against the vocabulary), so texts are cut into units at these places. A unit's segmentation is a function of which of
its draws skip. They are drawn as gaps, the merges between a skip and the next. A state is a unit and the gaps so far;
it knows the ids if nothing more is skipped, and the merges after its last skip: a longer gap ends there, a shorter one
leads to a next state. States hold nothing of a row; they are made as draws reach them, in arrays of many at a time,
and kept in arrays, whose bounded size changes no result: a batch's ids are gathered from there in one step.

Rules: null and empty texts have no ids and decode to the empty text. U+2581, which the model writes for a blank,
is encoded as its three bytes, so that it isn't taken for one. encode numbers equal rows as copies, which differ;
round_trip gives rows of equal key and text equal ids. Rows with a null key are told apart by their texts. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices
from .textkernel import mix

ALPHA, KEPT_STATES, LONG_UNIT = 0.1, 1_000_000, 48
#: A gap that no unit reaches.
NEVER = 1 << 30
BLANK = "▁"
_NO, _STEP = np.float32(np.inf), np.uint64(0x9E3779B97F4A7C15)
_STATE = np.dtype([("unit", "i4"), ("parent", "i4"), ("gap", "i4"), ("depth", "i4"), ("merges", "i4"), ("n_ids", "i4"), ("ids", "i8"), ("slots", "i8")])
_UNIT = np.dtype([("state", "i4"), ("length", "i4"), ("symbols", "i8")])
_open: dict[tuple, MergeDropout] = {}


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer copy, for so many entries; those to come are not set, so that they take no memory yet."""
    if size <= len(array):
        return array
    longer = np.empty(max(size, 2 * len(array)), array.dtype)
    longer[: len(array)] = array
    return longer


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class MergeDropout:
    def __init__(self, path: str, alpha: float = ALPHA, seed: int = 23, kept: int = KEPT_STATES):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback that keep the text as it is")
        self.alpha, self.seed, self.kept = alpha, seed, kept
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece holds a blank after another character")
        self.bytes = np.zeros(256, np.int64)
        self.decoded = [b""] * self.size
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.decoded[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.decoded[i] = p.piece.replace(BLANK, " ").encode()
        # Symbols: pieces, then size + code point for characters without one.
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, self.size + ord(c))
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)  # pairs by hash, then the next free slot; -1: none
        self.pair_keys, self.pair_ids = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        taken: set[int] = set()
        for pair, slot in zip(pairs, self._slot(np.array(list(pairs), np.int64)).tolist(), strict=True):
            while slot in taken:
                slot = (slot + 1) % len(self.pair_keys)
            taken.add(slot)
            self.pair_keys[slot], self.pair_ids[slot] = pair, pairs[pair]
        self.cost = np.array([-p.score for p in model.pieces], np.float32)
        self.cost_list = self.cost.tolist()
        self.pair_dict = pairs
        single = sorted((ord(c), i) for c, i in normal.items() if len(c) == 1)
        self.char_points, self.char_ids = (np.array(x, np.int64) for x in zip(*single, strict=True))
        apart = "".join(c for c in "\n\t" if not any(c in p for p in normal if len(p) > 1))
        # Letters that no piece holds before anything but such a letter: a unit may end where their run ends.
        letters = {c for c in map(chr, [*range(65, 123), *range(0xC0, 0x180)]) if c.isalpha()}
        neighbours = {(a, b) for p in normal for a, b in zip(p, p[1:])}
        while crossed := {a for a, b in neighbours if a in letters and b not in letters}:
            letters -= crossed
        run, rest = "".join(sorted(letters)), f"[^{BLANK}{apart}]"
        other = f"[^{BLANK}{apart}{run}]"
        inner = f"(?:{other}*[{run}]+|{other}+)" if letters else f"{rest}+"
        self.units = re.compile(f"{BLANK}*{inner}|{BLANK}+" + (f"|[{apart}]" if apart else ""))
        self._forget()

    # -- merging -----------------------------------------------------------------------------------------------

    def _candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (infinite: no merge) and piece of each pair of symbols."""
        pair = (left.astype(np.int64) << 32) | right
        slot = self._slot(pair)
        found = self.pair_keys[slot]
        other = np.nonzero((found != pair) & (found != -1))
        while len(other[0]):
            slot[other] = (slot[other] + 1) % len(self.pair_keys)
            found[other] = self.pair_keys[slot[other]]
            going = (found[other] != pair[other]) & (found[other] != -1)
            other = tuple(x[going] for x in other)
        piece = self.pair_ids[slot]
        ok = (found == pair) & (left >= 0) & (right >= 0)
        return np.where(ok, self.cost[piece], _NO), piece

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * _STEP) >> self.shift).view(np.int64)

    def _gaps(self, keys: np.ndarray, number: int | np.ndarray) -> np.ndarray:
        """Merges before the next skip, for the occurrences of these keys after so many skips."""
        if self.alpha <= 0:
            return np.full(len(keys), NEVER)
        if self.alpha >= 1:
            return np.zeros(len(keys), np.int64)
        drawn = mix(keys + np.asarray([number], np.uint64).ravel() * _STEP)
        even = ((drawn >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        return np.minimum(np.log(even) / np.log1p(-self.alpha), NEVER).astype(np.int64)

    def _keys(self, units: Sequence[str], salt: int) -> np.ndarray:
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        return mix(np.array([xxhash.xxh3_64_intdigest(b, self.seed & 0xFFFFFFFF) for b in raw], np.uint64) + np.array([salt], np.uint64) * _STEP)

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_points, points), len(self.char_points) - 1)
        return np.where(self.char_points[at] == points, self.char_ids[at], self.size + points)

    def _long(self, unit: str, key: int) -> list[int]:
        """One long unit with a heap as agenda: n log n."""
        skips, gaps = 0, self._gaps(np.array([key], np.uint64), 0).tolist()
        left_to_skip = gaps[0]
        symbols = self._symbols(unit).tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int, int]] = []
        costs = self.cost_list

        def add(i: int) -> None:
            j = after[i]
            if j >= 0 and (piece := self.pair_dict.get(symbols[i] << 32 | symbols[j])) is not None:
                heapq.heappush(agenda, (costs[piece], i, symbols[i], symbols[j], piece))

        for i in range(n - 1):
            add(i)
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            if not left_to_skip:
                skips += 1
                if skips >= len(gaps):
                    gaps += self._gaps(np.full(64, key, np.uint64), np.arange(skips, skips + 64)).tolist()
                left_to_skip = gaps[skips]
                continue
            left_to_skip -= 1
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            add(i)
            if before[i] >= 0:
                add(before[i])
        return [s for s in symbols if s >= 0]

    def _finished(self, symbols: list[int]) -> bytes:
        """Ids of symbols, with bytes for characters without a piece."""
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.size else self.bytes[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, "<u4").tobytes()

    def segment(self, units: Sequence[str], salt: int = 0) -> list[bytes]:
        """Ids of each unit as little-endian uint32 bytes, drawn by the unit itself and a salt."""
        return self._drawn(units, self._keys(units, salt))

    def _forget(self) -> None:
        self.state: dict[str, int] = defaultdict(itertools.count().__next__)  # a unit's number
        self._count = self._units = self._n_symbols = self._n_ids = self._n_slots = 0
        self._states, self._unit = np.empty(1024, _STATE), np.empty(1024, _UNIT)  # a unit's state without skips; -1: long
        self._all_symbols, self._all_ids = np.zeros(4096, np.int32), np.zeros(4096, "<u4")
        self._next = np.zeros(4096, np.int32)  # state by first slot of a state + gap; -1: not made yet

    def _add(self, units: np.ndarray, parents: np.ndarray, gaps: np.ndarray, depths: np.ndarray, made: tuple) -> np.ndarray:
        """New states, with what _agenda has made of them."""
        (ids, starts, counts), merges = made
        start, slots, held = self._count, self._n_slots, self._n_ids
        self._count, self._n_slots, self._n_ids = start + len(units), slots + int(merges.sum()), held + len(ids)
        self._states, self._next, self._all_ids = _room(self._states, self._count), _room(self._next, self._n_slots), _room(self._all_ids, self._n_ids)
        self._next[slots : self._n_slots] = -1
        self._all_ids[held : self._n_ids] = ids
        values = {"unit": units, "parent": parents, "gap": gaps, "depth": depths, "merges": merges, "n_ids": counts, "ids": held + starts, "slots": slots + np.cumsum(merges) - merges}
        for name, value in values.items():
            self._states[name][start : self._count] = value
        return np.arange(start, self._count)

    def _meet(self, units: list[str]) -> None:
        """Units that have just been numbered: their symbols and states without skips, but for long ones."""
        numbers = np.arange(self._units, self._units + len(units))
        self._units += len(units)
        self._unit = _room(self._unit, self._units)
        lengths = np.array([len(u) for u in units], np.int64)
        short = lengths <= LONG_UNIT
        self._unit["state"][numbers] = -1
        few, numbers, lengths = [u for u in units if len(u) <= LONG_UNIT], numbers[short], lengths[short]
        start, self._n_symbols = self._n_symbols, self._n_symbols + int(lengths.sum())
        self._all_symbols = _room(self._all_symbols, self._n_symbols)
        self._all_symbols[start : self._n_symbols] = self._symbols("".join(few))
        self._unit["length"][numbers], self._unit["symbols"][numbers] = lengths, start + np.cumsum(lengths) - lengths
        self._unit["state"][numbers] = self._add(numbers, -1, 0, 0, self._merged(few, [()] * len(few)))

    def _later(self, parents: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """New states, each of a parent and the gap to one more skip."""
        units, depths = self._states["unit"][parents], self._states["depth"][parents] + 1
        before = np.full((len(parents), int(depths.max()) + 1), NEVER, np.int32)
        rows, now, depth, gap = np.arange(len(parents)), parents, depths, gaps
        while len(rows):
            before[rows, depth - 1] = gap
            some = self._states["depth"][now] > 0
            rows, at = rows[some], now[some]
            depth, gap, now = self._states["depth"][at], self._states["gap"][at], self._states["parent"][at]
        made = self._agenda(self._all_symbols, self._unit["symbols"][units], self._unit["length"][units], before)
        return self._add(units, parents, gaps, depths, made)

    def _flat(self, units: Sequence[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, an occurrence with a key of its own, and where each unit's begin (and the last one's end)."""
        if self._count > self.kept:
            self._forget()
        numbers = np.fromiter(map(self.state.__getitem__, units), np.int64, len(units))
        if new := max(0, int(numbers.max(initial=-1)) + 1 - self._units):
            self._meet(list(itertools.islice(reversed(self.state), new))[::-1])
        at = self._unit["state"][numbers].astype(np.int64)
        long = np.flatnonzero(at < 0)
        going, skips = np.flatnonzero(at >= 0), 0
        while len(going):
            gap, now = self._gaps(keys[going], skips), at[going]
            more = gap < self._states["merges"][now]
            going, gap, now = going[more], gap[more], now[more]
            slots = self._states["slots"][now] + gap
            after = self._next[slots]
            if len(absent := np.flatnonzero(after < 0)):
                missing, one = np.unique(slots[absent], return_index=True)
                self._next[missing] = self._later(now[absent[one]], gap[absent[one]])
                after = self._next[slots]
            at[going] = after
            skips += 1
        counts = self._states["n_ids"][at].astype(np.int64)
        drawn = [np.frombuffer(self._finished(self._long(units[i], int(keys[i]))), "<u4") for i in long.tolist()]
        counts[long] = [len(x) for x in drawn]
        begins = np.concatenate([[0], np.cumsum(counts)])
        starts = self._states["ids"][at]
        starts[long] = 0
        out = self._all_ids[np.minimum(_ranges(starts, counts), len(self._all_ids) - 1)]
        for i, x in zip(long.tolist(), drawn, strict=True):
            out[begins[i] : begins[i + 1]] = x
            self.state.pop(units[i], None)
        return out, begins

    def _drawn(self, units: Sequence[str], keys: np.ndarray) -> list[bytes]:
        """Ids of each unit, an occurrence with a key of its own."""
        flat, begins = self._flat(units, keys)
        return [flat[a:b].tobytes() for a, b in itertools.pairwise(begins.tolist())]

    def _merged(self, units: list[str], before: list[tuple[int, ...]]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Ids, and merges after the last skip, of units whose skips come after these gaps."""
        lengths = np.array([len(u) for u in units], np.int64)
        gaps = np.full((len(units), max(map(len, before), default=0) + 1), NEVER, np.int32)
        for k, some in enumerate(before):
            gaps[k, : len(some)] = some
        return self._agenda(self._symbols("".join(units)).astype(np.int32), np.cumsum(lengths) - lengths, lengths, gaps)

    def _agenda(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gaps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Ids (all, starts, counts), and merges after the last skip, of units of these symbols; those of like length go through the agenda together."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        merges = np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 8192):
            rows = order[at : at + 8192]
            width = int(lengths[rows].max())
            symbols = np.full((len(rows), width), -1, np.int32)
            symbols[np.arange(width) < lengths[rows][:, None]] = flat[_ranges(starts[rows], lengths[rows])]
            self._merge(symbols, gaps[rows], rows, out, merges)
        found, counts, ids = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))
        begins, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        begins[found], n[found] = np.cumsum(counts) - counts, counts
        return (ids, begins, n), merges

    def _merge(self, symbols: np.ndarray, gaps: np.ndarray, rows: np.ndarray, out: list[tuple[np.ndarray, np.ndarray, np.ndarray]], merges: np.ndarray) -> None:
        cost, piece = self._candidates(symbols[:, :-1], symbols[:, 1:])
        skips, since = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        while len(rows):
            width = symbols.shape[1]
            each = np.arange(len(rows))
            best = cost.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            going = cost[each, best] < _NO if width > 1 else np.zeros(len(rows), bool)
            check = each[going & (since == gaps[each, skips])]
            while len(check):
                cost[check, best[check]] = _NO
                skips[check] += 1
                since[check] = 0
                best[check] = cost[check].argmin(axis=1)
                going[check] = cost[check, best[check]] < _NO
                check = check[going[check] & (gaps[check, skips[check]] == 0)]
            if not going.all():
                out.append(self._emitted(symbols[~going], rows[~going]))
                merges[rows[~going]] = since[~going]
                symbols, gaps, cost, piece, best, rows, skips, since = (x[going] for x in (symbols, gaps, cost, piece, best, rows, skips, since))
                each = np.arange(len(rows))
                if not len(rows):
                    return
            since += 1
            symbols[each, best] = piece[each, best]
            columns = np.arange(width)
            symbols = symbols[columns != best[:, None] + 1].reshape(len(rows), width - 1)
            keep = columns[:-1] != best[:, None]
            cost, piece = cost[keep].reshape(len(rows), width - 2), piece[keep].reshape(len(rows), width - 2)
            for to, some in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = each[some], to[some]
                cost[r, c], piece[r, c] = self._candidates(symbols[r, c], symbols[r, c + 1])

    def _emitted(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows, the number of ids of each, and all ids."""
        solid = symbols >= 0
        counts = solid.sum(axis=1)
        if not (special := (symbols >= self.size).any(axis=1)).any():
            return rows, counts, symbols[solid].astype("<u4")
        ids = [np.frombuffer(self._finished(x[x >= 0].tolist()), "<u4") for x in symbols[special]]
        both = np.concatenate([rows[~special], rows[special]])
        return both, np.concatenate([counts[~special], [len(x) for x in ids]]), np.concatenate([symbols[~special][solid[~special]].astype("<u4"), *ids])

    # -- texts -------------------------------------------------------------------------------------------------

    def encode(self, texts: Sequence[str | None], keys: Sequence[object], copies: Sequence[int] | None = None) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; copies: numbers that tell rows of equal key and text apart."""
        mark = self.bytes[list(BLANK.encode())].astype("<u4").tobytes()
        plan, units, draws = [], [], [np.zeros(0, np.uint64)]
        for text, key, copy in zip(texts, keys, copies or [0] * len(texts), strict=True):
            parts = [self.units.findall(x.replace(" ", BLANK)) for x in self._apart(text)]
            plan.append([len(p) for p in parts])
            for part in parts:
                units += part
            row = xxhash.xxh3_64_intdigest(f"{self.seed}:{'' if key is None else repr(key)}:{copy}")
            row = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), row)
            draws.append(mix(np.array([row], np.uint64) + np.arange(sum(plan[-1]), dtype=np.uint64) * _STEP))
        ids, begins = self._flat(units, np.concatenate(draws))
        out, ends, at = [], begins.tolist(), 0
        for lengths in plan:
            done = []
            for n in lengths:
                done.append(ids[ends[at] : ends[at + n]].tobytes())
                at += n
            out.append(mark.join(done))
        return out

    @staticmethod
    def _apart(text: str | None) -> list[str]:
        """A text with its dummy prefix, cut at every U+2581 of its own."""
        return (" " + text).split(BLANK) if text else []

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def opened(path: str, alpha: float, seed: int) -> MergeDropout:
    key = (path, alpha, seed)
    if key not in _open:
        _open.clear()
        _open[key] = MergeDropout(*key)
    return _open[key]


def _copied(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Each row (key, text, count) so many times, with the copies' numbers, in pieces of about so many bytes of text."""
    counts = batch.column(2).to_numpy()
    sizes = np.array([len(t or "") for t in batch.column(1).to_pylist()], np.int64)
    row, at = 0, 0
    while row < len(counts):
        rows, copies, room = [], [], most
        while row < len(counts) and room > 0:
            n = min(int(counts[row]) - at, max(1, room // max(1, int(sizes[row]))), most)
            rows += [row] * n
            copies += range(at, at + n)
            room, at = room - n * max(1, int(sizes[row])), at + n
            if at == counts[row]:
                row, at = row + 1, 0
        yield batch.take(pa.array(rows, pa.int64())), copies


def encode(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = 23) -> DataFrame:
    """docs (doc_id, text): returns doc_id, ids. Equal rows are counted first, so that each is a copy with a number, wherever it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(path, alpha, seed)
        for part in slices(batches, "text"):
            for batch, copies in _copied(part):
                ids = model.encode(batch.column(1).to_pylist(), batch.column(0).to_pylist(), copies)
                ends = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.groupBy("doc_id", "text").count().mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids): returns doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(path, 0.0, 0)
        for batch in batches:
            texts = [model.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = 23) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_ids, ids_crc32 (of the ids as little-endian uint32), n_bytes, text_crc32 (of the decoded text), lossless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(path, alpha, seed)
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            ids = model.encode(texts, batch.column(0).to_pylist())
            back = [model.decode(i) for i in ids]
            raw = [b.encode("utf-8", "surrogatepass") for b in back]
            columns = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_ids", "ids_crc32", "n_bytes", "text_crc32", "lossless"])

    source = docs.select("doc_id", "text")
    more = [T.StructField(c, T.LongType()) for c in ("n_ids", "ids_crc32", "n_bytes", "text_crc32")]
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *more, T.StructField("lossless", T.BooleanType())]))
