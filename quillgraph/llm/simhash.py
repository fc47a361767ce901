"""Op 3: SimHash near-dedup with BK-trees.

A fingerprint has a bit set if over half the hashes of a text's word shingles (repeats included) have it set.
Distinct fingerprints are dealt into shards that any two within the radius share: of `radius + 2` bit blocks at least
two are untouched, so a shard is a pair of blocks and their value. A shard holds a BK-tree: children are keyed by
their Hamming distance to the parent, and a search follows only edges within the radius of the distance at hand. Shard
trees are built in the tasks that own the shards instead of being broadcast, as their number grows with the data.
Shards over CHUNK fingerprints are dealt anew by a part of their other bits: these are cut into radius + 1 parts, of
which one is untouched. What is still over CHUNK is cut into chunks by a hash; each chunk's tree then meets each
chunk's queries, so no task holds a whole shard. A meeting returns a spanning forest of its links, at most one edge
each fingerprint, and distributed components join the forests; no link between different fingerprints is lost. Copies
are grouped by fingerprint before anything is dealt out.

`near_copies` is the form for near copies at a Jaccard similarity of 5-word shingles; every pair at the similarity or
over it is joined. Texts of equal shingle sets are one node. Fingerprints of distinct shingles go through the same shard
trees, and the links found are verified by exact shingle sets: that joins large groups by few edges. All pairs that
this leaves apart come from an exact prefix filter: sets at the similarity share one of their first shingles in any
common order, with sizes and places that allow the similarity, and with sketches that allow it: the bits that differ in
two sets' odd counts are at most the shingles that one of them lacks. Of these, each text first proposes one partner of
another group, in two rounds that are verified and joined; the pairs that are still of different groups are then listed
and verified, so a group whose texts are all nearly, but not quite, at the similarity is listed as far as sketches do not
part it. The order is by hash; shingles that over RUN first places hold are put last for the documents that have them,
and what they still share goes through chunks like a hot shard.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other (near copies: they have
equal, empty sets, so one stays); fewer words than a shingle: all words are the shingle; null ids are one id that comes
last and is returned as null; repeated rows are returned as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.graph.components import connected_components
from quillgraph.llm.tables import table
from quillgraph.session import cut, text_batches, written

SEED = 42
RADIUS = 3
CHUNK = 256
RUN = 256
PARTS = 256
#: Bits of a set's sketch; it parts sets of up to about twice as many shingles.
BITS = 512
MAX_BROADCAST_IDS = 400_000
#: Links in a partition of the component rounds.
LINKS = 100_000
#: Bits of 32 that texts at the similarity often differ by at most; it chooses partners, and drops none.
CLOSE = 3
_NO_ID = 2**63 - 1
_SLICE = 1 << 16

SIMILARITY, SHINGLE = 0.8, 5


def shingles(text: str | None, size: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[n:] for n in range(size)))))


def hashes(grams: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), "<u8", len(grams))


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of hashes; the 0th is the hash itself."""
    if n:
        h = h * np.uint64(2 * n * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
    return h


def majority(found: np.ndarray, words: int = 1) -> bytes:
    """`words` little-endian 64-bit words; a bit is set if over half the hashes have it set."""
    counts = np.zeros((words, 64), np.int64)
    for start in range(0, len(found), _SLICE):
        h = found[start : start + _SLICE]
        for n in range(words):
            counts[n] += np.unpackbits(mixed(h, n).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), axis=1).tobytes()


def fingerprint(text: str | None, size: int = 3, words: int = 1) -> bytes:
    return majority(hashes(shingles(text, size)), words)


class BKTree:
    """Of integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            distance = (value ^ self.values[at]).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = len(self.values)
                break
            at = self.children[at][distance]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, index) of all values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append((distance, at))
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [child for edge, child in children.items() if -radius <= edge - distance <= radius]
            else:
                todo += [children[edge] for edge in range(distance - radius, distance + radius + 1) if edge in children]
        return found


def forest(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Edges, nearest first, that connect what links within `left` (right is None) or between the two connect.

    Ends are indices into left + right.
    """
    tree, links = BKTree(), []
    for n, value in enumerate(left):
        if right is None:
            links += [(d, at, n) for d, at in tree.within(value, radius)]
        tree.add(value)
    for n, value in enumerate(right or ()):
        links += [(d, at, len(left) + n) for d, at in tree.within(value, radius)]
    parent = list(range(len(left) + len(right or ())))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for _, a, b in sorted(links):
        if (p := root(a)) != (q := root(b)):
            parent[p] = q
            out.append((a, b))
    return out


def _fingerprints(size: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py(), size, words) for text in batch["text"]]
            if words == 1:
                yield pa.RecordBatch.from_pydict({"id": batch["id"], "print": pa.array(np.frombuffer(b"".join(prints), "<i8"), pa.int64())})
            else:
                yield pa.RecordBatch.from_pydict({"id": batch["id"], "print": pa.array(prints, pa.binary())})

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1) -> DataFrame:
    """(id, print): a long for one word, else a binary; null ids become the largest long."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(size, words), f"id long, print {'long' if words == 1 else 'binary'}")


def _links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def values(column: pa.ListArray) -> list[int]:
        flat = column.flatten().field("print")
        if pa.types.is_integer(flat.type):
            return [int(x) for x in flat.to_numpy(zero_copy_only=False).view(np.uint64)]
        return [int.from_bytes(x, "little") for x in flat.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for n in range(batch.num_rows):
                left, right = batch["left"].slice(n, 1), batch["right"].slice(n, 1)
                self_meeting = right.null_count == 1
                ids = left.flatten().field("id").to_pylist() + ([] if self_meeting else right.flatten().field("id").to_pylist())
                for a, b in forest(values(left), None if self_meeting else values(right), radius):
                    src.append(ids[a])
                    dst.append(ids[b])
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _small(rows: DataFrame, many: int) -> DataFrame:
    return F.broadcast(rows) if many <= MAX_BROADCAST_IDS else rows


def shard_links(keyed: DataFrame, links: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], finer: Column | None = None) -> DataFrame:
    """(src, dst) ids that `links` finds within shards of keyed(shard, key, id, print).

    `finer` is an array of further keys, of which any two that link share one; shards over CHUNK are dealt by it.
    """
    counts = keyed.groupBy("shard", "key").agg(F.count("*").alias("n")).where("n > 1")
    hot = cut(counts.where(F.col("n") > CHUNK).select("shard", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("pieces")))
    many = hot.count()
    packed = F.collect_list(F.struct("id", "print"))
    nothing = F.lit(None).cast(f"array<struct<id:bigint,print:{keyed.schema['print'].dataType.simpleString()}>>").alias("right")
    cold = keyed.join(_small(hot, many), ["shard", "key"], "left_anti") if many else keyed
    out = cold.groupBy("shard", "key").agg(packed.alias("left")).where(F.size("left") > 1).select("left", nothing).mapInArrow(links, "src long, dst long")
    if not many:
        return out
    rows = cut(keyed.join(_small(hot, many), ["shard", "key"]))
    if finer is not None:
        rows = rows.select("id", "print", F.xxhash64("shard", "key").alias("old"), F.posexplode(finer).alias("part", "key")).select(F.xxhash64("old", "part").alias("shard"), "key", "id", "print")
        return out.unionByName(shard_links(rows, links))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "print"), F.col("pieces")).cast("int"))
    pieces = cut(rows.groupBy("shard", "key", "chunk").agg(packed.alias("piece")))
    other = pieces.select("shard", "key", F.col("chunk").alias("other"), F.col("piece").alias("right"))
    met = pieces.join(other, ["shard", "key"]).where("chunk <= other")
    met = met.select(F.col("piece").alias("left"), F.when(F.col("chunk") != F.col("other"), F.col("right")).alias("right"))
    return out.unionByName(met.mapInArrow(links, "src long, dst long"))


def components_of(links: DataFrame) -> DataFrame:
    """Components of links, in as many partitions as their number asks for."""
    return connected_components(links, partitions=max(1, -(-links.count() // LINKS)))


def meetings(rows: DataFrame, pairs: bool, columns: tuple[str, ...]) -> DataFrame:
    """(key, left, right) of rows(key, chunk, component, ...): each chunk alone, and pairs of chunks of one bucket.

    A chunk alone needs two nodes; where `pairs` meet too, any meeting needs two components.
    """
    packed = F.collect_list(F.struct(*columns))
    chunks = rows.groupBy("key", "chunk").agg(packed.alias("left"), F.min("component").alias("low"), F.max("component").alias("high"))
    kind = ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in columns)
    nothing = F.lit(None).cast(f"array<struct<{kind}>>").alias("right")
    if not pairs:
        return chunks.where(F.size("left") > 1).select("key", "left", nothing)
    chunks = written(chunks)
    alone = chunks.where("low <> high").select("key", "left", nothing)
    several = chunks.groupBy("key").agg(F.max("chunk").alias("last")).where("last > 0").select("key")
    rest = chunks.join(several, "key", "left_semi")
    other = rest.select("key", F.col("chunk").alias("other"), F.col("left").alias("right"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    met = rest.join(other, "key").where("chunk < other and (low <> high or other_low <> other_high or low <> other_low)")
    return alone.unionByName(met.select("key", "left", "right"))


def open_rows(rows: DataFrame) -> DataFrame:
    """The rows(key, component, ...) of keys that hold several components."""
    left = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return written(rows.join(left, "key", "left_semi"))


def finer_keys(print_col: Column, radius: int = RADIUS) -> Column:
    """Array of the values of radius + 1 parts of every print's bits, of which prints within the radius share one."""
    step = 64 // (radius + 1)
    return F.array(*[F.shiftrightunsigned(print_col, step * n).bitwiseAND(F.lit((1 << step) - 1)) for n in range(radius + 1)])


def block_keys(print_col: Column, radius: int = RADIUS) -> Column:
    """Array of (shard, key): values of all pairs of radius + 2 blocks of 64 bits."""
    edges = [64 * n // (radius + 2) for n in range(radius + 3)]
    blocks = [F.shiftrightunsigned(print_col, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(edges, edges[1:])]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    pairs = combinations(range(len(blocks)), 2)
    return F.array(*[F.struct(F.lit(n).alias("shard"), F.shiftleft(blocks[a], width).bitwiseOR(blocks[b]).alias("key")) for n, (a, b) in enumerate(pairs)])


def near_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, component) of every row: fingerprints within the radius are linked, component is the least id."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("print").agg(F.min("id").alias("least")))
    # a fingerprint stands for its copies; as the node of the graph it is the long itself
    nodes = distinct.select(F.col("print").alias("id"), "print")
    keyed = nodes.select("id", "print", F.explode(block_keys(F.col("print"), radius)).alias("k")).select("k.shard", "k.key", "id", "print")
    component = connected_components(shard_links(keyed, _links(radius), finer_keys(F.col("print"), radius)))
    found = component.join(distinct, component["node"] == distinct["print"]).select("node", "component", "least")
    least = found.groupBy("component").agg(F.min("least").alias("first"))
    known = cut(found.join(least, "component").select(F.col("node").alias("print"), "first"))
    groups = cut(distinct.join(known, "print", "left").select("print", F.coalesce("first", "least").alias("component")))
    return prints.join(groups, "print").select("id", "print", "component")


def _restored(c: str) -> Column:
    return F.when(F.col(c) != _NO_ID, F.col(c))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.select(_restored("id").alias("doc_id"), name.alias("fingerprint"), _restored("component").alias("component_id"))


def _grams(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                grams = gram_set(batch["text"][n].as_py(), size)
                yield pa.RecordBatch.from_pydict({"row": batch["row"].slice(n, 1), "grams": pa.array([grams.tobytes()], pa.binary())})

    return run


def _verified(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["a"], batch["b"]):
                a, b = (np.frombuffer(v.as_py(), "<i8") for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def gram_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text in rising order, as signed numbers, so that Spark sorts them alike."""
    return np.unique(hashes(shingles(text, size)).view("<i8"))


def _first(similarity: float, many: int) -> int:
    """How many shingles of a set are first ones."""
    return many - math.ceil(similarity * many - 1e-9) + 1 if many else 0


def sketch(grams: np.ndarray) -> bytes:
    """A bit for each of BITS parts of a set: whether the number of its shingles there is odd."""
    return np.packbits(np.bincount(grams & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, BITS // 64)


def _described(size: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the fingerprint of the distinct shingles, a digest of their set, their number, a sketch and the first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                prints, sets, sizes, sketches, first = [], [], [], [], []
                for text in part["text"]:
                    grams = gram_set(text.as_py(), size)
                    prints.append(majority(grams.view("<u8")))
                    sets.append(xxhash.xxh128_digest(grams.tobytes()))
                    sizes.append(len(grams))
                    sketches.append(sketch(grams))
                    first.append(grams[: _first(similarity, len(grams))])
                offsets = np.r_[0, np.cumsum([len(x) for x in first])].astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *first]), pa.int64()))
                found = {"print": pa.array(np.frombuffer(b"".join(prints), "<i8"), pa.int64()), "set": pa.array(sets, pa.binary()), "n": pa.array(sizes, pa.int32()), "sketch": pa.array(sketches, pa.binary()), "first": listed}
                yield pa.RecordBatch.from_pydict({"id": part["id"]} | found)

    return run


def _may(similarity: float, n: np.ndarray, at: np.ndarray, other_n: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be at the similarity if a shared shingle has these places."""
    return np.minimum(n - at, other_n - other_at) >= similarity / (1 + similarity) * (n + other_n) - 1e-6


def _allowed(similarity: float, x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Whether rows of different components, one of them new, may be at the similarity; x and y broadcast."""
    fits = (x["component"] != y["component"]) & (x["new"] | y["new"] > 0)
    fits = fits & _may(similarity, x["n"], x["at"], y["n"], y["at"])
    if "sketch" in x and fits.any():
        apart = np.bitwise_count(x["sketch"] ^ y["sketch"]).sum(-1, dtype=np.int64)
        fits &= apart <= (1 - similarity) / (1 + similarity) * (x["n"] + y["n"]) + 1e-6
    return fits


def _pairs(similarity: float, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """(src, dst) of all pairs that a shared shingle allows."""
    x, y = np.triu_indices(len(rows["id"]), 1)
    fits = _allowed(similarity, *({c: v[i] for c, v in rows.items()} for i in (x, y)))
    return {"src": rows["id"][x[fits]], "dst": rows["id"][y[fits]]}


def _partners(least: bool) -> Callable[[float, dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """One partner for each row that a shared shingle allows some: (src, dst, far), and the row's h, place and hint.

    That is the nearest by hint; with `least`, the least of those that are CLOSE, if any are.
    """

    def pick(similarity: float, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        fits = _allowed(similarity, {c: v[:, None] for c, v in rows.items()}, rows)
        some = np.flatnonzero(fits.any(1))
        far = np.bitwise_count((rows["hint"][some, None] ^ rows["hint"]).astype(np.uint32)).astype(np.int64)
        if least:
            far[far <= CLOSE] = 0
        far[~fits[some]] = 99
        order = np.argsort(rows["id"], kind="stable")  # the first of equally near ones is the least
        best = order[far[:, order].argmin(1)]
        place = (rows["n"] << 32) | (rows["at"] << 1) | rows["new"]
        return {"src": rows["id"][some], "dst": rows["id"][best], "far": far[np.arange(len(some)), best]} | {"h": rows["h"][some], "place": place[some], "hint": rows["hint"][some]}

    return pick


_PAIR, _PARTNER = ("src", "dst"), ("src", "dst", "far", "h", "place", "hint")
_PARTNER_SCHEMA = ", ".join(f"{c} long" for c in _PARTNER)


def _runs(similarity: float, most: int, pick: Callable[[float, dict[str, np.ndarray]], dict[str, np.ndarray]], columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (h, component): what `pick` finds among those of one h, or src null and dst h if over `most` share it.

    Only runs that hold several components, and a row that is `new`, count. Rows may have a sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        over = None  # (h, first component, several components, new) of a run that is over `most`, whose rows are let go

        def found(parts: list[dict[str, np.ndarray]], hot: list[int]) -> pa.RecordBatch:
            out = {c: np.concatenate([np.empty(0, np.int64), *(p[c] for p in parts), np.array(hot, np.int64)]) for c in columns}
            return pa.RecordBatch.from_pydict({c: pa.array(x, mask=np.arange(len(x)) >= len(x) - len(hot) if c == "src" else None) for c, x in out.items()})

        def closed(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            parts, hot = [], []
            mixed_runs = (ends - starts > 1) & (rows["component"][starts] != rows["component"][ends - 1])
            for a, b in zip(starts[mixed_runs].tolist(), ends[mixed_runs].tolist()):
                part = {c: x[a:b] for c, x in rows.items()}
                if not part["new"].any():
                    continue
                if b - a > most:
                    hot.append(int(part["h"][0]))
                else:
                    parts.append(pick(similarity, part))
            return found(parts, hot)

        for batch in batches:
            place = batch["place"].to_numpy()
            fresh = {c: batch[c].to_numpy() for c in ("h", "component", "id")} | {"n": place >> 32, "at": (place & 0xFFFFFFFF) >> 1, "new": place & 1}
            fresh["hint"] = batch["hint"].to_numpy() if "hint" in batch.schema.names else np.zeros(len(place), np.int64)
            if "sketch" in batch.schema.names:
                fresh["sketch"] = _sketches(batch["sketch"])
            rows = fresh if held is None else {c: np.concatenate([held[c], x]) for c, x in fresh.items()}
            if over is not None:
                same = rows["h"] == over[0]
                over = (over[0], over[1], over[2] or bool((rows["component"][same] != over[1]).any()), over[3] or bool(rows["new"][same].any()))
                rows = {c: x[~same] for c, x in rows.items()}
                if not len(rows["h"]):
                    held = rows
                    continue
                if over[2] and over[3]:
                    yield found([], [over[0]])
                over = None
            if not len(rows["h"]):
                continue
            starts = np.flatnonzero(np.r_[True, rows["h"][1:] != rows["h"][:-1]])
            yield closed(rows, starts[:-1], starts[1:])
            held = {c: x[starts[-1] :] for c, x in rows.items()}
            if len(held["h"]) > most:
                over = (int(held["h"][0]), int(held["component"][0]), bool((held["component"] != held["component"][0]).any()), bool(held["new"].any()))
                held = {c: x[:0] for c, x in held.items()}
        if over is not None and over[2] and over[3]:
            yield found([], [over[0]])
        if held is not None and len(held["h"]):
            yield closed(held, np.array([0]), np.array([len(held["h"])]))

    return run


def _met(similarity: float, pick: Callable[[float, dict[str, np.ndarray]], dict[str, np.ndarray]] | None, columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `pick` finds in chunks that meet nobody; without it, all pairs (src, dst) of meetings."""

    def read(key: int, column: pa.ListArray) -> dict[str, np.ndarray]:
        flat = column.flatten()
        rows = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "place", "hint")}
        return rows | {"h": np.full(len(flat), key), "n": rows["place"] >> 32, "at": (rows["place"] & 0xFFFFFFFF) >> 1, "new": rows["place"] & 1, "sketch": _sketches(flat.field("sketch"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                key, right = batch["key"][n].as_py(), batch["right"].slice(n, 1)
                here = read(key, batch["left"].slice(n, 1))
                if right.null_count == 1:
                    out = (pick or _pairs)(similarity, here)
                    yield pa.RecordBatch.from_pydict({c: pa.array(out[c]) for c in columns})
                    continue
                there = read(key, right)
                x, y = np.nonzero(_allowed(similarity, {c: v[:, None] for c, v in here.items()}, there))
                yield pa.RecordBatch.from_pydict({"src": pa.array(here["id"][x]), "dst": pa.array(there["id"][y])})

    return run


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, text, ...) of wanted(id, row, ...), each row once."""
    wanted = cut(wanted)
    return texts.join(_small(wanted, wanted.count()), "id").drop("id").dropDuplicates(["row"])


def _sketched(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                counts = np.bincount(gram_set(batch["text"][n].as_py(), size) & (PARTS - 1), minlength=PARTS)
                yield pa.RecordBatch.from_pydict({"row": batch["row"].slice(n, 1), "counts": pa.array([np.minimum(counts, 0xFFFF).astype("<u2").tobytes()], pa.binary())})

    return run


def _possible(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose counts by part allow the similarity: sets share at most the lesser count in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, PARTS).astype(np.int64) for c in "ab")
            both = np.minimum(a, b).sum(1)
            full = ((a == 0xFFFF) | (b == 0xFFFF)).any(1)
            keep = full | (both >= similarity * (a.sum(1) + b.sum(1) - both) - 1e-6)
            yield batch.select(["src", "dst"]).filter(pa.array(keep))

    return run


def _with_ends(pairs: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    a, b = (ends.select(F.col("row").alias(end), F.col(column).alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")


def _verified_links(texts: DataFrame, rows: DataFrame, links: DataFrame, similarity: float, size: int) -> DataFrame:
    """(src, dst) of the links between rows(row, id) whose texts are at the similarity.

    Most candidates fall to counts of shingles in PARTS parts; only the others' sets travel.
    """
    pairs = cut(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())

    def ends(of: DataFrame) -> DataFrame:
        return _texts_of(texts, rows.join(of.select(F.explode(F.array("src", "dst")).alias("row")).distinct(), "row").select("id", "row"))

    counts = cut(ends(pairs).mapInArrow(_sketched(size), "row long, counts binary"))
    pairs = cut(_with_ends(pairs, counts, "counts").mapInArrow(_possible(similarity), "src long, dst long"))
    grams = cut(ends(pairs).mapInArrow(_grams(size), "row long, grams binary"))
    return cut(_with_ends(pairs, grams, "grams").mapInArrow(_verified(similarity), "src long, dst long"))


def _run_links(keyed: DataFrame, similarity: float, most: int) -> DataFrame:
    """(src, dst) of keyed(h, component, id, place, sketch), place being n << 32 | at << 1 | new; see _runs."""
    rows = keyed.select("h", "component", "id", "place", "sketch").repartition("h").sortWithinPartitions("h", "component", "id")
    return cut(rows.mapInArrow(_runs(similarity, most, _pairs, _PAIR), "src long, dst long").distinct())


def _run_partners(keyed: DataFrame, similarity: float, least: bool) -> DataFrame:
    """_PARTNER columns of keyed(h, component, id, place, hint), with or without a sketch; see _runs."""
    rows = keyed.select("h", "component", "id", "place", "hint", *(c for c in keyed.columns if c == "sketch")).repartition("h").sortWithinPartitions("h", "component", "id")
    return written(rows.mapInArrow(_runs(similarity, RUN, _partners(least), _PARTNER), _PARTNER_SCHEMA))


def _placed(nodes: DataFrame, new: bool) -> DataFrame:
    """(h, component, id, place, hint) of the first shingles of nodes(row, component, n, hint, first)."""
    at = nodes.select("row", "component", "n", "hint", F.posexplode("first").alias("at", "h"))
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR(F.lit(int(new)))
    return at.select("h", "component", F.col("row").alias("id"), place.alias("place"), "hint")


def _reordered(similarity: float, size: int, last: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first shingles of texts if those in `last` come last."""
    late = np.array(sorted(last), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                grams = gram_set(batch["text"][n].as_py(), size)
                hot = np.isin(grams, late)
                first = np.concatenate([grams[~hot], grams[hot]])[: _first(similarity, len(grams))]
                listed = pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), pa.array(first, pa.int64()))
                yield pa.RecordBatch.from_pydict({c: batch[c].slice(n, 1) for c in ("row", "component", "n", "hint")} | {"first": listed})

    return run


def _listed(similarity: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                grams = gram_set(batch["text"][n].as_py(), size)
                listed = pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams, pa.int64()))
                many = pa.array([_first(similarity, len(grams))], pa.int32())
                yield pa.RecordBatch.from_pydict({c: batch[c].slice(n, 1) for c in ("row", "component", "n", "hint")} | {"places": many, "h": listed})

    return run


def _prefix_rows(texts: DataFrame, nodes: DataFrame, similarity: float, size: int) -> tuple[DataFrame, DataFrame | None]:
    """First shingles by which nodes(row, id, component, n, hint, first) may be at the similarity to one of another component.

    Rows (key, id, place, hint) of shingles that at most RUN hold; rows of those that more hold whatever comes first, or
    None. Any pair at the similarity shares a key in one of them.
    """
    keyed = _placed(nodes, True)
    found = _run_partners(keyed, similarity, True)
    few, hot = found.where("src is not null"), cut(found.where("src is null").select(F.col("dst").alias("h")))
    few = few.select(F.xxhash64(F.lit(0), "h").alias("key"), F.col("src").alias("id"), "place", "hint")
    many = hot.count()
    if not many:
        return few, None
    held = cut(keyed.join(_small(hot, many), "h", "left_semi").select(F.col("id").alias("row")).distinct())
    n_held = held.count()
    held_texts = _texts_of(texts, nodes.join(_small(held, n_held), "row").select("id", "row", "component", "n", "hint"))
    if many <= MAX_BROADCAST_IDS:
        last = [r.h for r in hot.collect()]  # checked to be few
        anew = held_texts.mapInArrow(_reordered(similarity, size, last), "row long, component long, n int, hint long, first array<long>")
    else:
        grams = held_texts.mapInArrow(_listed(similarity, size), "row long, component long, n int, hint long, places int, h array<long>")
        grams = grams.select("row", "component", "n", "hint", "places", F.explode("h").alias("h")).join(hot.withColumn("late", F.lit(True)), "h", "left")
        listed = grams.groupBy("row", "component", "n", "hint", "places").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(False)).alias("late"), "h"))).alias("all"))
        anew = listed.select("row", "component", "n", "hint", F.transform(F.expr("slice(all, 1, places)"), lambda x: x["h"]).alias("first"))
    # pairs of rows that are not new were found before
    both = _placed(nodes.join(_small(held, n_held), "row", "left_anti"), False).unionByName(_placed(written(anew), True))
    found = _run_partners(both, similarity, True)
    few = few.unionByName(found.where("src is not null").select(F.xxhash64(F.lit(1), "h").alias("key"), F.col("src").alias("id"), "place", "hint"))
    still = cut(found.where("src is null").select(F.col("dst").alias("h")))
    if not (many := still.count()):
        return few, None
    return few, written(both.join(_small(still, many), "h", "left_semi").select(F.col("h").alias("key"), "id", "place", "hint"))


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(key, id, ...) of keys that hold several components under these links."""
    found = cut(components_of(links).select(F.col("node").alias("id"), "component"))
    return open_rows(rows.join(_small(found, found.count()), "id", "left").withColumn("component", F.coalesce("component", "id")))


def _chunked(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("pieces"))
    return rows.join(counts, "key").withColumn("chunk", F.pmod(F.xxhash64("key", "id"), F.col("pieces")).cast("int")).drop("pieces")


def _prefix_links(texts: DataFrame, found: DataFrame, nodes: DataFrame, near: DataFrame, similarity: float, size: int) -> DataFrame:
    """(src, dst) of verified links that join what the links `near` leave apart of nodes(row, id, component, n, hint, first).

    Twice each node proposes one partner of another component, first a low one that all near ones share, then its nearest;
    pairs are listed only of what is still apart. A row without a partner that sketches allow has none later.
    """
    schema, columns = _PARTNER_SCHEMA, ("id", "component", "place", "hint", "sketch")
    sketches = found.select(F.col("row").alias("id"), "sketch")
    sparse, crowd = _prefix_rows(texts, nodes, similarity, size)
    links = None
    for least in (True, False):
        known = near if links is None else near.unionByName(links)
        picked = _run_partners(_relabelled(sparse, known).join(sketches, "id").withColumnRenamed("key", "h"), similarity, least)
        sparse = picked.select(F.col("h").alias("key"), F.col("src").alias("id"), "place", "hint")
        proposed = picked.select("src", "dst", "far")
        if crowd is not None:
            crowd = _relabelled(crowd.drop("component"), known)
            alone = meetings(_chunked(crowd.join(sketches, "id")), False, columns).mapInArrow(_met(similarity, _partners(least), _PARTNER), schema)
            proposed = proposed.unionByName(alone.select("src", "dst", "far"))
        best = proposed.groupBy("src").agg(F.min(F.struct("far", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst"))
        fresh = _verified_links(texts, found, best, similarity, size)
        links = fresh if links is None else links.unionByName(fresh)
    known = near.unionByName(links)
    pairs = _run_links(_relabelled(sparse, known).join(sketches, "id").withColumnRenamed("key", "h"), similarity, RUN)
    if crowd is not None:
        crowd = _relabelled(crowd.drop("component"), known)
        pairs = pairs.unionByName(meetings(_chunked(crowd.join(sketches, "id")), True, columns).mapInArrow(_met(similarity, None, _PAIR), "src long, dst long"))
    return links.unionByName(_verified_links(texts, found, pairs, similarity, size))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of every distinct id: near copies share the least id of their group.

    Ids must tell rows apart; rows of one id must have one text.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(_described(size, similarity), "id long, print long, set binary, n int, sketch binary, first array<long>")
    # numbers of rows are shorter than ids, which may be hashes
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    sets = cut(found.groupBy("set").agg(F.min("row").alias("node"), F.min("print").alias("print")))
    keyed = sets.select(F.col("node").alias("id"), "print", F.explode(block_keys(F.col("print"))).alias("k")).select("k.shard", "k.key", "id", "print")
    near = _verified_links(texts, found, shard_links(keyed, _links(RADIUS), finer_keys(F.col("print"))), similarity, size)
    joined = cut(components_of(near).select("node", "component"))
    of_set = cut(sets.select("set", "node").join(joined, "node", "left"))
    # rows that stand for themselves and no other need no entry
    other = cut(found.select("row", "set").join(of_set, "set").where("row <> node or component <> row").select("row", F.when(F.col("row") == F.col("node"), F.col("component")).alias("to")))
    nodes = found.join(_small(other.withColumn("listed", F.lit(True)), other.count()), "row", "left").where("listed is null or to is not null")
    nodes = nodes.select("row", "id", F.coalesce("to", "row").alias("component"), "n", F.col("print").bitwiseAND(0xFFFFFFFF).alias("hint"), "first")
    rest = _prefix_links(texts, found, nodes, near, similarity, size)
    component = components_of(near.unionByName(rest))
    groups = cut(sets.select("set", "node").join(component, "node", "left").select("set", F.coalesce("component", "node").alias("group")))
    members = found.select("id", "set").join(groups, "set")
    least = members.groupBy("group").agg(F.min("id").alias("component"))
    return members.select("id", "group").distinct().join(least, "group").select("id", "component")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id, null ids last.

    A node is a distinct (doc_id, text), so rows that only share an id, or have none, go by their texts like any other;
    of rows equal in both, the least in all columns stays.
    """
    node = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keys = docs.select(node.alias("_node"), F.col("doc_id").cast("long").alias("_id"), "text")
    groups = cut(near_copies(keys.select("_node", "text"), id_col="_node"))
    ids = keys.groupBy("_node").agg(F.min("_id").alias("_id"))
    place = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_node"))
    first = groups.join(ids, F.col("id") == F.col("_node")).groupBy("component").agg(F.min(place).alias("place"))
    rows = docs.withColumn("_node", node).join(cut(first.select(F.col("place._node").alias("_kept"))), F.col("_node") == F.col("_kept"), "left_semi")
    if rows.groupBy("_node").count().where("count > 1").isEmpty():
        return rows.drop("_node")
    rows = rows.groupBy("_node").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])
