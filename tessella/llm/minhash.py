"""MinHash near-duplicates of whole texts: SuperMinHash signatures, bands, exact verification, union of links.

SuperMinHash: each shingle draws a random permutation of the signature's places; its j-th place gets the value
j + r, and a place keeps the smallest value. Values of step j lie under those of step j + 1, so all shingles of a
batch go through step 0, then 1, ..., and a text stops as soon as every place is filled (early stopping): texts of
many shingles need one or two steps. The permutation is built by the Fisher-Yates swaps as far as it is needed.

Plan. Texts with equal shingle sets form one class (128-bit digest of the set and its size). Bands of class
representatives meet by key. First each member is compared with its band's smallest one, a star, so thousands of near
copies give thousands of pairs and not millions; those whose sizes and signatures don't rule out the threshold (4.5
standard deviations below) are checked, a hub's text going once to dozens of members; links found are united. Then,
in bands that still hold different components, all pairs of different components are compared by signature, in tiles of
bounded rows and bytes, and checked where they meet, so that a tile returns its links and not its pairs. Members of a
band's largest component meet only the others. Bands with more others than a tile holds, such as those of a passage that
many documents share, go an exact way instead: their members meet by each shingle of their prefixes. A prefix is a set's
first shingles, the rarest first, as many as leave fewer than a link needs: sets that reach the threshold share one of
them. The order, by bounded counters and then by hash, is the same for all sets, so no link depends on the counters.
Prefix groups are tiled like bands, whatever their size. Checks read the whole texts and compare full sets, in whole
numbers. The texts that bands need are fetched once.

Every pair of a band is so either checked, ruled out or already joined by links. A pair of exactly the threshold shares
no band of 32 x 4 with a chance under 6e-6, and is ruled out with one under 4e-6, or 1e-12 among a wide band's members.

Rules: null, empty and wordless texts have the empty set and link with nothing; a text of fewer than 5 words has
its whole sequence as the one shingle. Rows with a null id link with nothing and are kept. Rows that repeat an
id count by the text of each for their set, and the id's component joins what any of its rows links to. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, remove, slices, text_bytes, tidy, written
from .components import components
from .textkernel import mix, shingle_sets

PLACES, ROWS_OF_BAND, SHINGLE = 128, 4, 5
#: Members of a tile's side at most, and of a band's largest component at least; bytes of its sets; members of a star that a hub goes to at once.
TILE, SIDE, TILE_BYTES, STAR = 1024, 128, 1 << 25, 64
#: Counters of shingles in wide bands, which order prefixes.
COUNTERS = 1 << 18
#: Standard deviations under the threshold from which on signatures rule a pair out, and in prefix groups, whose band is PREFIX.
SPREADS, PREFIX_SPREADS, PREFIX = 4.5, 8.0, -1
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(elements: np.ndarray, begins: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set: uint64, step in the high 16 bits, 48 random bits below. Empty sets: all bits set."""
    texts = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    out = np.full((len(begins) - 1, places), _EMPTY, np.uint64)
    swaps = None
    for step in range(places):
        draw = mix(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = np.uint64(step << 48) | (draw >> np.uint64(16))
        pick = step + (((draw & np.uint64(0xFFFF)) * np.uint64(places - step)) >> np.uint64(16)).astype(np.int64)
        if swaps is None:
            place = pick
        else:
            rows = np.arange(len(elements))
            place = swaps[rows, pick].astype(np.int64)
            swaps[rows, pick] = swaps[:, step]
        new = out[texts, place] >= np.uint64(step << 48)
        np.minimum.at(out, (texts[new], place[new]), value[new])
        open_ = (out == _EMPTY).any(axis=1)[texts]
        if not open_.any():
            break
        if swaps is None:
            elements, texts, pick = elements[open_], texts[open_], pick[open_]
            swaps = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(elements), 1))
            swaps[np.arange(len(elements)), pick] = 0
        elif not open_.all():
            elements, texts, swaps = elements[open_], texts[open_], swaps[open_]
    return out


def _set_sums(elements: np.ndarray, begins: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)))])
    return mix(sums[begins[1:]] - sums[begins[:-1]])


SKETCH = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, signature binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        elements, begins = shingle_sets(*text_bytes(batch.column(1)), SHINGLE)
        values = signatures(elements, begins)
        n, bands = len(values), PLACES // ROWS_OF_BAND
        keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, 1))
        for k in range(ROWS_OF_BAND):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k::ROWS_OF_BAND])
        short = mix(values).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(begins).astype(np.int64)),
                pa.array(_set_sums(elements, begins, 0x5851F42D4C957F2D).view(np.int64)),
                pa.array(_set_sums(elements, begins, 0x14057B7EF767814F).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))),
                pa.array([row.tobytes() for row in short], pa.binary()),
            ],
            ["doc_id", "n_shingles", "digest_a", "digest_b", "bands", "signature"],
        )
    tidy()


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted distinct values, reach the threshold; in whole numbers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _least(percent: int, spreads: float) -> int:
    """Places in which the signatures of a pair at the threshold agree at least, but for so many standard deviations' chance."""
    return int(percent / 100 * PLACES - spreads * (percent / 100 * (1 - percent / 100) * PLACES) ** 0.5)


def _near(least: int):
    """Keeps the pairs (a, b, signature_a, signature_b) whose signatures agree in so many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
            near = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in (0, 1)], ["a", "b"])

    return run


def _star(percent: int):
    """Rows (a, part, b, text) ordered by a, part and b, the hub's own (b null) first: the pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, []
        for batch in slices(batches, "text"):
            elements, begins = shingle_sets(*text_bytes(batch.column(3)), SHINGLE)
            a, part, b = (batch.column(c).to_pylist() for c in (0, 1, 2))
            linked = []
            for k in range(batch.num_rows):
                own = elements[begins[k] : begins[k + 1]]
                if (a[k], part[k]) != now:
                    now, hub = (a[k], part[k]), []
                if b[k] is None:
                    hub.append(own.copy())  # an id of several rows has several sets
                elif any(_linked(h, own, percent) for h in hub):
                    linked.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(linked, pa.int64())) for c in (0, 2)], ["a", "b"])
        tidy()

    return run


class _Tile:
    """Members of one band's tile. Pairs to decide: of different components, one of each side, signatures near enough.

    Pairs likely to be links are decided wherever they meet, so that what they join is known in each tile; the others
    only in the first band that they share, or in any prefix group.
    """

    def __init__(self, table: pa.Table, percent: int):
        self.band, self.likely = table.column("band").to_numpy(), percent / 100 * PLACES
        least = _least(percent, PREFIX_SPREADS if (self.band == PREFIX).any() else SPREADS)
        self.reps, self.component = table.column("rep").to_numpy(), table.column("component").to_numpy()
        low, high, part = (table.column(c).to_numpy() for c in ("low", "high", "part"))
        self.same, self.left, self.least = bool((low == high).all()), part == low, least
        self.signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(self.reps), -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows i, j; those whose signatures agree most first."""
        found = [np.zeros((3, 0), np.int64)]
        for i in range(len(self.reps)) if self.same else np.flatnonzero(self.left):
            others = np.arange(i + 1, len(self.reps)) if self.same else np.flatnonzero(~self.left)
            others = others[self.component[others] != self.component[i]]
            agree = (self.signatures[others] == self.signatures[i]).sum(axis=1)
            first = self.band[i] == PREFIX or self._first_band(i, others) == self.band[i]
            some = (agree >= self.likely) | (agree >= self.least) & first
            others, agree = others[some], agree[some]
            found.append(np.stack([np.full(len(others), i), others, agree]))
        i, j, agree = np.concatenate(found, axis=1)
        order = np.argsort(-agree, kind="stable")
        return i[order], j[order]

    def _first_band(self, i: int, others: np.ndarray) -> np.ndarray:
        return (self.signatures[others] == self.signatures[i]).reshape(len(others), PLACES // ROWS_OF_BAND, ROWS_OF_BAND).all(axis=2).argmax(axis=1)


def _undecided(percent: int):
    """Keeps a tile's members that have a pair to decide."""

    def run(table: pa.Table) -> pa.Table:
        i, j = _Tile(table, percent).pairs()
        return table.take(pa.array(np.union1d(i, j)))

    return run


def _decided(percent: int):
    """Links between components in a tile, from full sets: at most one fewer than its components.

    The likeliest pairs are checked first; pairs whose components have been joined meanwhile need no check.
    """

    def run(table: pa.Table) -> pa.Table:
        tile, sets = _Tile(table, percent), []
        for batch in slices(iter(table.select(["text"]).combine_chunks().to_batches()), "text"):
            elements, begins = shingle_sets(*text_bytes(batch.column(0)), SHINGLE)
            sets += [elements[a:b].copy() for a, b in zip(begins, begins[1:], strict=False)]
        root = {c: c for c in tile.component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for i, j in zip(*(x.tolist() for x in tile.pairs()), strict=True):
            x, y = find(int(tile.component[i])), find(int(tile.component[j]))
            if x != y and _linked(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                links.append((int(tile.reps[i]), int(tile.reps[j])))
        return pa.table({"a": pa.array([min(p) for p in links], pa.int64()), "b": pa.array([max(p) for p in links], pa.int64())})

    return run


def _mixed(rest: DataFrame) -> DataFrame:
    """Bands of different components: key, big (its largest component), members and bytes of sets of that one and of the others."""
    each = rest.groupBy("key", "component").agg(F.count("*").alias("n"), (8 * F.sum("n_shingles")).alias("bytes"))
    found = each.groupBy("key").agg(F.max(F.struct("n", "component", "bytes")).alias("big"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    others = (F.col("n") - F.col("big.n")).alias("others")
    return found.filter("n > big.n").select("key", F.col("big.component").alias("big"), F.col("big.n").alias("in_big"), others, F.col("big.bytes").alias("big_bytes"), (F.col("bytes") - F.col("big.bytes")).alias("other_bytes"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's texts fall on each counter."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in slices(batches, "text"):
        elements, _ = shingle_sets(*text_bytes(batch.column(1)), SHINGLE)
        counts += np.bincount((elements % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["counter", "n"])
    tidy()


def _prefixes(common: np.ndarray, percent: int):
    """The shingles of each text's prefix: the first by counter and hash, one more than a link may lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            elements, begins = shingle_sets(*text_bytes(batch.column(1)), SHINGLE)
            sizes = np.diff(begins)
            texts = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.lexsort((elements, common[(elements % np.uint64(COUNTERS)).astype(np.int64)], texts))
            lengths = sizes - -(-percent * sizes // 100) + 1
            some = np.arange(len(elements)) - begins[texts] < lengths[texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts[some])), pa.array(elements[order[some]].view(np.int64))], ["rep", "shingle"])
        tidy()

    return run


def _narrowed(rest: DataFrame, texts: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """rest with the bands of more than hot members besides their largest component replaced by groups of equal prefix shingles, and its bands."""
    mixed = written(_mixed(rest), "mixed")
    wide = mixed.filter(F.col("others") > hot).select("key")
    if wide.isEmpty():
        return rest, mixed
    crowd = written(rest.join(wide, "key").groupBy("rep", "component").agg(F.max("n_shingles").alias("n_shingles")), "crowd")
    own = texts.select(F.col("doc_id").alias("rep"), "text").join(crowd.select("rep"), "rep", "left_semi")
    counted = own.mapInArrow(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(COUNTERS, np.int64)
    common[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    prefixes = own.mapInArrow(_prefixes(common, percent), "rep long, shingle long").distinct()
    key = F.xxhash64(F.lit("prefix"), "shingle").alias("key")
    closer = crowd.join(prefixes, "rep").select(key, F.lit(PREFIX).alias("band"), "rep", "component", "n_shingles")
    rest = written(rest.join(wide, "key", "left_anti").unionByName(closer), "narrowed")
    for done in (mixed, crowd):
        remove(done)
    return rest, written(_mixed(rest), "mixed")


def _tiled(rest: DataFrame, mixed: DataFrame, classes: DataFrame, tile: int) -> DataFrame:
    """rest with signatures and a row for each tile (key, low, high) of a member: all of a band's pairs but those within its largest component.

    That component's members are in parts of at least as many as the others, so that neither side is copied more often
    than the other is large; the others meet each other too.
    """
    at_least = lambda n, size, bytes_: F.greatest(F.ceil(F.col(n) / size), F.ceil(F.col(bytes_) / F.lit(TILE_BYTES))).cast("int")
    side = F.greatest(F.lit(min(SIDE, tile)), F.least("others", F.lit(tile)))
    sizes = mixed.select("key", "big", at_least("others", F.lit(tile), "other_bytes").alias("outer"), at_least("in_big", side, "big_bytes").alias("inner"))
    rest = rest.select("key", "band", "rep", "component").join(sizes, "key").withColumn("in", F.col("component") == F.col("big"))
    rest = rest.join(classes.select("rep", "signature"), "rep")  # once for a band's member, before the tiles copy it
    part = F.when(F.col("in"), F.col("outer") + F.pmod(F.xxhash64("rep"), "inner")).otherwise(F.pmod(F.xxhash64("rep"), "outer")).cast("int")
    last = F.when(F.col("in"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    rest = rest.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rest.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "band", "rep", "component", "part", "signature")


def near_duplicates(docs: DataFrame, percent: int = 75, tile: int = TILE) -> DataFrame:
    """docs (doc_id, text): returns doc_id, n_shingles, component_id, kept for each row."""
    docs = docs.select("doc_id", "text")
    sketch = written(docs.mapInArrow(_sketches, SKETCH), "sketch")
    able = sketch.filter("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "digest_a", "digest_b"]
    classes = able.groupBy(*digest).agg(F.min(F.struct("doc_id", "bands", "signature")).alias("least"))
    classes = written(classes.select(*digest, F.col("least.doc_id").alias("rep"), "least.bands", "least.signature"), "classes")

    # Links of an id: an id of several rows is in several classes; each of them links to the id's smallest representative.
    of_id = able.select("doc_id", *digest).distinct().join(classes.select(*digest, "rep"), digest).select("doc_id", "rep")
    members = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    members = written(members, "bands")
    met = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    met = written(members.join(met, "key"), "met")
    remove(members)

    pairs = met.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"signature_{c}"))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b", "signature_a", "signature_b")
    pairs = near = written(pairs.mapInArrow(_near(_least(percent, SPREADS)), "a long, b long").distinct(), "pairs")
    needed = pairs.select("a").union(pairs.select("b")).union(met.filter("n > 2").select("rep")).distinct()
    texts = written(docs.join(needed.withColumnRenamed("a", "doc_id"), "doc_id"), "texts")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts"))
    pairs = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    rays = hubs.unionByName(pairs.withColumn("doc_id", F.col("b"))).join(texts, "doc_id").select("a", "part", "b", "text")
    rays = rays.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    star = written(rays.mapInArrow(_star(percent), "a long, b long"), "star")
    reached = components(star).withColumnRenamed("node", "rep")

    # What no star has decided: pairs of different components, none of them the hub, in bands of three and more.
    rest = met.filter("n > 2 and rep <> hub").join(reached, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = rest.select("key", "band", "rep", "component", "n_shingles")
    rest, mixed = _narrowed(rest, texts, percent, tile)
    rest = _tiled(rest, mixed, classes, tile)
    rest = written(rest.groupBy("key", "low", "high").applyInArrow(_undecided(percent), rest.schema), "undecided")
    late = rest.join(texts.withColumnRenamed("doc_id", "rep"), "rep").groupBy("key", "low", "high").applyInArrow(_decided(percent), "a long, b long")
    late = written(late, "late")
    for done in (near, texts, met, mixed, rest):  # read by no later plan
        remove(done)
    same = of_id.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    links = components(star.unionByName(late).unionByName(same)).withColumnRenamed("node", "rep")
    told = classes.select(*digest, "rep").join(links, "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", *digest).join(told, digest, "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs with one document of each group: the smallest id; rows that repeat an id stay one. Null ids stay."""
    own = fresh(docs.columns, "__id")
    kept = near_duplicates(docs, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    with_id = docs.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(own), "left_semi")
    columns = named(docs.columns)
    return with_id.dropDuplicates(["doc_id"]).select(*columns).unionByName(docs.filter(F.col("doc_id").isNull()).select(*columns))
