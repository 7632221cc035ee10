"""Token ids in files of directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of CHUNK bits, lowest first. Level 0 holds the first chunk of every id, level 1 the second
chunk of the ids that have one, and so on; each level but the last has a bitmap that tells which ids go on, and a
rank directory (set bits before every 512) to find their place in the next level. Token i: its chunk at level 0;
if its bit is set, the place in level 1 is the rank of i; and so on.

A file image is: magic, header (chunk bits, levels, documents, tokens), documents (id, its validity, where its
tokens begin), then for each level its length, chunks, bitmap and directory. Images hold at most IMAGE tokens (or
one document), cover consecutive documents in id order, and are rows of a Parquet container (segment, number,
tokens, image), written and read by Spark's own writers, so that any store that Spark reaches will do; export()
puts single images on a mounted disk.

Documents are dealt to segments by ranges of ids from a sample (any bounds give the same ids; they only balance),
sorted within, and encoded as they stream by. Ids are those of the tokenizers library: texts are cut into pieces that
it encodes apart, found by their bytes in a memory of bounded size, many at a time; a text with an added token's
opening or without the library's plain rules goes to the library whole. Rows of one id are in one segment.

Rules: null and empty texts have the end id alone. Documents come in ascending id, null ids first; rows that repeat
an id come in the order of their texts, equal rows alike. An empty table gives no image and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, text_bytes, written
from .textkernel import LOWER, mix

MAGIC, CHUNK, RANK_BITS, IMAGE = b"TDAC0001", 8, 512, 1 << 20
#: Segments are tasks, and their number is bounded by what a shuffle bears; of a larger table each takes more rows, as a stream.
SEGMENTS, SAMPLE = 100_000, 50


# -- codes -----------------------------------------------------------------------------------------------------


def encode_ids(ids: np.ndarray, chunk: int = CHUNK) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) for each level."""
    kind = np.uint8 if chunk <= 8 else np.uint16
    rest, out = np.asarray(ids, np.uint32), []
    while True:
        more = rest >> np.uint32(chunk)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS)).astype(np.uint32) if len(goes_on) else np.zeros(0, np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)])
        out.append(((rest & np.uint32((1 << chunk) - 1)).astype(kind), bits, ranks))
        rest = more[goes_on]
        if not len(rest):
            return out


class Image:
    """A file image, opened without decoding. get(i): the i-th token; ids(a, b): tokens a..b of it."""

    def __init__(self, data: bytes | memoryview):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.chunk, levels, documents, self.tokens = struct.unpack_from("<IIII", data, len(MAGIC))
        at = len(MAGIC) + 16

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.valid, self.begins = take(np.int64, documents), take(np.uint8, documents).astype(bool), take(np.uint32, documents + 1)
        kind = np.uint8 if self.chunk <= 8 else np.uint16
        self.levels = []
        for _ in range(levels):
            (n,) = take(np.uint32, 1)
            self.levels.append((take(kind, n), take(np.uint8, (n + 7) // 8), take(np.uint32, -(-int(n) // RANK_BITS) + 1)))

    def get(self, i: int) -> int:
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            block = i // RANK_BITS
            whole = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.unpackbits(whole).sum()) + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            shift += self.chunk
        return out

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """A run of tokens; the deeper levels' runs are found by rank, so nothing before is decoded."""
        end = self.tokens if end is None else end
        parts = []
        for chunks, bits, ranks in self.levels:
            goes_on = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].astype(bool)
            parts.append((chunks[start:end].astype(np.uint32), goes_on))
            block = start // RANK_BITS
            start = int(ranks[block]) + int(np.unpackbits(bits[block * RANK_BITS // 8 : (start + 7) >> 3], bitorder="little")[: start - block * RANK_BITS].sum())
            end = start + int(goes_on.sum())
            if start == end:
                break
        out, _ = parts.pop()
        while parts:
            chunks, goes_on = parts.pop()
            chunks[goes_on] |= out << np.uint32(self.chunk)
            out = chunks
        return out


def image_bytes(doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray, chunk: int = CHUNK) -> bytes:
    levels = encode_ids(ids, chunk)
    begins = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
    parts = [MAGIC, struct.pack("<IIII", chunk, len(levels), len(doc_ids), len(ids)), doc_ids.astype(np.int64).tobytes(), valid.astype(np.uint8).tobytes(), begins.tobytes()]
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<I", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


# -- tokens ----------------------------------------------------------------------------------------------------

WIDE, ENTRIES, KEPT_IDS, KEPT_LONG = 24, 1 << 20, 1 << 23, 1 << 24
_SPACE, _WORD, _DIGIT, _OTHER = range(4)
#: Of each byte of a text that fits _LATIN; later bytes of a character take its first one's class.
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), 39, 0xC3, 0xC4, 0xC5]] = _WORD
_KINDS[48:58] = _DIGIT
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: ASCII, Latin letters from U+00C0 to U+017F but the dotted capital I, and dashes and quotes: no marks, no other blanks.
_LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027]*")
#: An apostrophe next to what is neither a letter nor white space: there the tokenizer's contractions aren't runs.
_QUOTE = re.compile(r"'[^A-Za-z\u00c0-\u017f\x20\t-\r]|[^A-Za-z\u00c0-\u017f\x20\t-\r]'")
_open: dict[str, PieceEncoder] = {}


class PieceMemory:
    """Ids of pieces by their bytes, in arrays of fixed size; forgets everything when one is full.

    Pieces of up to WIDE bytes are found, many at a time, in an open-addressed table whose keys are their bytes and
    length; longer ones in a dictionary. At most ENTRIES pieces, KEPT_IDS ids and KEPT_LONG bytes of long pieces are
    kept beyond the batch at work.
    """

    def __init__(self, entries: int = ENTRIES):
        self.entries, self.mask = entries, 4 * entries - 1
        self.forget()

    def forget(self) -> None:
        self.count = self.used = self.long_bytes = 0
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.zeros((1024, 4), np.uint64)
        self.starts = np.zeros(1025, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.long: dict[bytes, int] = {}

    def full(self) -> bool:
        return self.count > self.entries or self.used > KEPT_IDS or self.long_bytes > KEPT_LONG

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 3].copy()
        for k in range(3):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + keys[:, k])
        return h

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        found, todo, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            entry = self.slots[at[todo]]
            todo, entry = todo[entry >= 0], entry[entry >= 0]
            same = (self.keys[entry] == keys[todo]).all(axis=1)
            found[todo[same]] = entry[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & self.mask
        return found

    def add(self, blobs: list[bytes], keys: np.ndarray | None = None, h: np.ndarray | None = None) -> int:
        """New entries; with keys (different ones) they go into the table. Returns the first one's number."""
        first, n = self.count, len(blobs)
        flat = np.frombuffer(b"".join(blobs), "<u4")
        while len(self.keys) < first + n:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        self.starts = np.concatenate([self.starts, np.zeros(max(0, len(self.keys) + 1 - len(self.starts)), np.int64)])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first + 1 : first + n + 1] = self.used + np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)
        self.count, self.used = first + n, self.used + len(flat)
        if keys is not None:
            while 2 * self.count > len(self.slots):  # one batch of many pieces: the table grows until it is forgotten
                self._rehash()
            self.keys[first : first + n] = keys
            self._place(np.arange(first, first + n), h)
        return first

    def _place(self, entries: np.ndarray, h: np.ndarray) -> None:
        todo, at = np.arange(len(entries)), (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = entries[free]  # of several the last one stays
            todo = todo[self.slots[at[todo]] != entries[todo]]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)

    def _rehash(self) -> None:
        held = self.slots[self.slots >= 0]
        self.slots = np.full(2 * len(self.slots), -1, np.int32)
        self.mask = len(self.slots) - 1
        self._place(held, self.hashes(self.keys[held]))


class PieceEncoder:
    """A tokenizer of the tokenizers library behind a bounded memory of pieces.

    Pieces may be encoded apart where the tokenizer turns white space runs into a blank and drops it; that is read
    from its file. Else, and where a text may hold an added token, the library gets the whole text. In Latin texts
    pieces are the runs of letters, single digits and runs of other characters that the tokenizer cuts, smaller and
    so more often equal; elsewhere what white space parts.
    """

    def __init__(self, path: str, kept: int = ENTRIES):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text())
        normal = (rules.get("normalizer") or {}).get("normalizers", [])
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.apart = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} in normal and split.get("behavior") == "Removed" and bool(split.get("invert")) and not rules.get("post_processor")
        # The runs above are the tokenizer's own if it lower-cases and cuts by this pattern.
        self.fine = self.apart and {"type": "Lowercase"} in normal and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.added = sorted({t["content"][:2] for t in rules.get("added_tokens", []) if t["content"]})
        self.memory = PieceMemory(kept)

    def _library(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 4096) for e in encode(texts[at : at + 4096], add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the tokenizer keeps apart: many in one text, divided by the library's word numbers."""
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        out: list[bytes] = []
        for at in range(0, len(groups), 16):
            some = groups[at : at + 16]
            for group, e in zip(some, self.tokenizer.encode_batch([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                numbers, ids = np.array([-1 if w is None else w for w in e.word_ids]), np.array(e.ids, "<u4")
                ends = np.append(np.flatnonzero(np.diff(numbers)) + 1, len(ids)) if len(ids) else np.zeros(0, np.int64)
                if len(ends) != len(group) or (numbers < 0).any():
                    out += self._library(group)
                    continue
                blob, start = ids.tobytes(), 0
                for end in (ends * 4).tolist():
                    out.append(blob[start:end])
                    start = end
        return out

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces; those of one word each go many at a time."""
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        own = [t.isalpha() for t in texts]
        words, rest = iter(self._words([t for t, o in zip(texts, own, strict=True) if o])), iter(self._library([t for t, o in zip(texts, own, strict=True) if not o]))
        return [next(words if o else rest) for o in own]

    def _pieces(self, data: np.ndarray, begins: np.ndarray, latin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin and end in the data; latin: the texts to be cut by classes."""
        kinds = _KINDS[data]
        later = np.flatnonzero((data & 0xC0) == 0x80)  # all of a dash or quote are others by the table
        kinds[later] = kinds[later - 1]
        solid = kinds != _SPACE
        plain = np.repeat(~latin, np.diff(begins))
        kinds[plain & solid] = _OTHER
        edge = np.ones(len(data), bool)
        edge[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        edge[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        some = solid[starts]
        return starts[some], ends[some]

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memory's entry of each piece; makes those that are missing."""
        memory, lengths = self.memory, ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(lengths <= WIDE)
        padded = np.concatenate([data, np.zeros(WIDE + 8, np.uint8)])
        eights = np.ndarray((len(data) + WIDE + 1,), "<u8", padded, strides=(1,))
        keys = np.empty((len(short), 4), np.uint64)
        for k in range(WIDE // 8):
            left = np.clip(lengths[short] - 8 * k, 0, 8)
            keys[:, k] = eights[starts[short] + 8 * k] & _MASKS[left]
        keys[:, 3] = lengths[short]
        h = memory.hashes(keys)
        found = memory.find(keys, h)
        while len(missing := np.flatnonzero(found < 0)):
            one = missing[np.unique(h[missing], return_index=True)[1]]  # of equal hashes one a round
            raw = [data[a:b].tobytes() for a, b in zip(starts[short[one]].tolist(), ends[short[one]].tolist(), strict=True)]
            memory.add(self._new(raw), keys[one], h[one])
            found[missing] = memory.find(keys[missing], h[missing])
        out[short] = found
        if len(long := np.flatnonzero(lengths > WIDE)):
            raw = [data[a:b].tobytes() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            new = list({p for p in raw if p not in memory.long})
            first = memory.add(self._new(new))
            memory.long.update(zip(new, range(first, first + len(new)), strict=True))
            memory.long_bytes += sum(map(len, new))
            out[long] = [memory.long[p] for p in raw]
        return out

    def arrays(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, one after another, and how many each text has; null counts as empty."""
        if self.memory.full():
            self.memory = PieceMemory(self.memory.entries)
        column = column.fill_null("")
        whole = np.ones(len(column), bool)
        if self.apart:
            whole = np.zeros(len(column), bool)
            for opening in self.added:
                whole |= pc.match_substring(column, opening).to_numpy(zero_copy_only=False)
        data, begins = text_bytes(pc.if_else(pa.array(whole), "", column))
        latin = np.zeros(len(column), bool)
        if self.fine and len(data):
            latin = self._latin(column, data, begins)
            lower = LOWER[data]
            data = np.where(np.repeat(latin, np.diff(begins)), lower, data)
        counts = np.zeros(len(column), np.int64)
        starts, ends = self._pieces(data, begins, latin) if len(data) else (np.zeros(0, np.int64),) * 2
        entry = self._entries(data, starts, ends)
        sizes = self.memory.starts[entry + 1] - self.memory.starts[entry]
        text = np.searchsorted(begins, starts, "right") - 1
        counts += np.bincount(text, sizes, len(column)).astype(np.int64)
        places = np.repeat(self.memory.starts[entry] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        ids = self.memory.ids[places]
        if whole.any():
            blobs = [np.frombuffer(b, "<u4") for b in self._library(column.filter(pa.array(whole)).to_pylist())]
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, blob in zip(np.flatnonzero(whole).tolist(), blobs, strict=True):
                parts[k], counts[k] = blob, len(blob)
            ids = np.concatenate(parts)
        return ids, counts

    def _latin(self, column: pa.Array, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Texts to be cut by classes: those of ASCII and the characters of _LATIN whose apostrophes stand between letters or blanks."""
        ok, high = np.ones(len(column), bool), np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 128) | (data == 39), out=high[1:])
        for k in np.flatnonzero(high[begins[1:]] > high[begins[:-1]]).tolist():
            text = column[k].as_py()
            ok[k] = _LATIN.fullmatch(text) is not None and not ("'" in text and _QUOTE.search(text))
        return ok

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        ids, counts = self.arrays(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def encoder(path: str) -> PieceEncoder:
    if path not in _open:
        _open[path] = PieceEncoder(path)
    return _open[path]


# -- files -----------------------------------------------------------------------------------------------------

CONTAINER = "segment int, number int, tokens long, image binary"


def _images(path: str, end_id: int, chunk: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc_ids, counts, ids of rows that await their image
        size, segment, number = 0, None, 0

        def flush() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[2] for h in held])
            image = image_bytes(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), np.concatenate([h[1] for h in held]), ids, chunk)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["segment", "number", "tokens", "image"])

        for batch in slices(batches, "text"):
            ids, counts = own.arrays(batch.column(2))
            ids, counts = _ended(ids, counts, end_id), counts + 1
            segments, doc_ids = batch.column(0).to_numpy(), batch.column(1)
            ends = np.cumsum(counts)
            row = 0
            while row < len(counts):
                if held and (segments[row] != segment or size + counts[row] > most):
                    yield flush()
                    size, number = 0, number + 1 if segments[row] == segment else 0
                before = ends[row] - counts[row]
                # As many rows of the segment as the image has room for, one at least.
                room = int(np.searchsorted(ends, before + most - size, "right"))
                last = max(row + 1, min(room, int(np.searchsorted(segments, segments[row], "right"))))
                segment = int(segments[row])
                held.append((doc_ids.slice(row, last - row), counts[row:last], ids[before : ends[last - 1]]))
                size, row = size + int(ends[last - 1] - before), last
        if held:
            yield flush()

    return run


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id after each text's."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, chunk: int = CHUNK, to: str | None = None, segment_rows: int = 4096, most: int = IMAGE) -> str:
    """Writes the ids of docs (doc_id, text) as a container of images; returns its path. tokenizer: a file's path."""
    spark = docs.sparkSession
    to = to or new_path(spark, "tokens")
    docs = docs.select("doc_id", "text")
    rows = docs.count()
    segments = min(SEGMENTS, max(1, -(-rows // segment_rows)))
    bounds = _bounds(docs, rows, segments) if segments > 1 else []
    # The bounds go as one array; a segment is the number of bounds that the id has reached.
    dealt = docs.withColumn("segment", _segment(bounds)).repartitionById(len(bounds) + 1, "segment").sortWithinPartitions("segment", F.col("doc_id").asc_nulls_first(), "text")
    dealt.select("segment", "doc_id", "text").mapInArrow(_images(tokenizer, end_id, chunk, most), CONTAINER).write.parquet(to)
    return to


def _bounds(docs: DataFrame, rows: int, segments: int) -> list[int]:
    """Ids that part the table into about equal segments, from SAMPLE ids a segment: at most 40 MB on the driver."""
    ids = docs.select("doc_id").filter("doc_id is not null").sample(min(1.0, SAMPLE * segments / rows), 11).toArrow().column("doc_id").to_numpy()
    return np.unique(np.sort(ids)[np.arange(1, segments) * len(ids) // segments]).tolist() if len(ids) else []


def _segment(bounds: list[int]):
    def run(ids: pa.Array) -> pa.Array:
        place = np.searchsorted(np.array(bounds, np.int64), ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
        return pa.array(place.astype(np.int32))

    return F.arrow_udf(run, "int")(F.col("doc_id")) if bounds else F.lit(0)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            image = Image(memoryview(batch.column(3)[k].as_buffer()))  # where the batch holds it
            ids = image.ids().astype("<u4")
            begins = image.begins.astype(np.int64)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[k].as_py(), np.int32)), pa.array(image.doc_ids, mask=~image.valid), pa.array(begins[:-1]), pa.array(np.diff(begins)), pa.array(crcs, pa.int64())],
                ["segment", "number", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads a container back: doc_id, start, n_tokens, ids_crc32 for each document, all from the images."""
    images = spark.read.schema(CONTAINER).parquet(path)
    totals = written(images.select("segment", "number", "tokens"), "totals")
    # Tokens before an image: those of the segments before (at most SEGMENTS rows in one window) and in its own segment.
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = totals.groupBy("segment").agg(F.sum("tokens").alias("tokens")).select("segment", before(Window.orderBy("segment")).alias("earlier"))
    totals = totals.select("segment", "number", before(Window.partitionBy("segment").orderBy("number")).alias("inside")).join(segments, "segment")
    rows = images.mapInArrow(_read_back, "segment int, number int, doc_id long, within long, n_tokens long, ids_crc32 long")
    start = F.col("earlier") + F.col("inside") + F.col("within")
    return rows.join(totals, ["segment", "number"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Puts the images as files <segment>-<number>.dac into a folder that the driver sees, one at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for row in spark.read.schema(CONTAINER).parquet(path).toLocalIterator():
        Path(folder, f"{row.segment:06d}-{row.number:06d}.dac").write_bytes(row.image)
        n += 1
    return n
