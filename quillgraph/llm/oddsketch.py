"""Op 13: MinHash near-dedup with odd sketches.

A document's set holds its distinct shingles. BANDS * ROWS MinHash samples of it serve twice. Bands of ROWS samples give
the candidates: sets at the similarity of 0.8 share one of 60 bands of 6 with all but 1.2e-8 of the odds. And all samples
fold into an odd sketch, a bitmap in which each (sample number, value) flips one bit: what two sets have in common
cancels out, so the population count of the XOR tells how many samples differ, the more precisely the fewer they are.
Pairs over `most_bits` are dropped unread; the bound lies six deviations past a pair just at the similarity. What is
left is confirmed on the full sets, so a link is exact.

Sets, not documents, are the nodes; copies share a node. Buckets are dealt into chunks of about CHUNK nodes, so no task
holds a whole bucket, and their pairs are not listed. First each node of a chunk proposes its link to the least node that
its sketch allows, and the least of all its bands is confirmed: one link a node. Chunks then meet only where a bucket
still has several components, and each node proposes its nearest node of another one. What both rounds leave apart is
confirmed where it meets: nodes that still have a partner of another component take their sets along, a pair is read in
the first band that it shares, and a task lists no pair but the links that join components. No pair at the similarity that
shares a band is left.

Defined cases: a null, empty or blank text has an empty set, is linked with nothing and kept; fewer words than a shingle
are one shingle; repeated rows are one node, each is returned, and a row is kept if its id is its component's, so rows
that repeat an id are kept together; null ids come last and count as equal to each other there; an empty table gives an
empty result. Sets are told apart by 128 bits, shingles by 64.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.simhash import _small, components_of, gram_set, meetings, open_rows
from quillgraph.llm.tables import table
from quillgraph.session import cut, text_batches, written

SIMILARITY, SHINGLE = 80, 2
BANDS, ROWS = 60, 6
SAMPLES = BANDS * ROWS
BITS = 512
CHUNK = 256
#: Shingles of the sets that meet in one chunk of the last round, 8 bytes each.
SHINGLES = 1 << 20
DEVIATIONS = 6
_SKETCHED = ("id", "n", "component", "sketch")
_SPANNED = ("id", "n", "component", "sketch", "bands", "chunk")
_NO_ID = 2**63 - 1
_SLICE = 1024

_draw = np.random.default_rng(20241)
_FACTORS = _draw.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _draw.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_PLACES = _draw.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_BAND_FACTORS = _draw.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_OFFSETS = _draw.integers(0, 2**63, BANDS, dtype=np.uint64)


def samples(grams: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes that is not empty."""
    h = (grams.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(h), _SLICE):
        values = h[start : start + _SLICE, None] * _FACTORS
        values += _OFFSETS
        np.minimum(least, values.min(0), out=least)
    return least


def sketch(values: np.ndarray) -> bytes:
    """The odd sketch: each sample flips the bit that its number and value name."""
    at = (values ^ _PLACES) * np.uint32(0x85EBCA6B)
    at ^= at >> np.uint32(15)
    at = at * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(at, minlength=BITS) & 1).tobytes()


def band_keys(values: np.ndarray) -> np.ndarray:
    key = (values.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(1, dtype=np.uint64) ^ _BAND_OFFSETS
    key ^= key >> np.uint64(31)
    return (key * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimated(bits: np.ndarray) -> np.ndarray:
    """The similarity that a number of differing bits stands for: E[bits] = BITS/2 * (1 - (1 - 2/BITS)^(2 * SAMPLES * (1 - similarity)))."""
    left = np.maximum(1 - 2 * bits / BITS, 1e-9)
    return 1 - np.log(left) / math.log(1 - 2 / BITS) / (2 * SAMPLES)


def most_bits(similarity: int = SIMILARITY, deviations: float = DEVIATIONS) -> int:
    """The number of differing bits that a pair at the similarity exceeds only past so many deviations."""
    apart = 1 - similarity / 100
    flips, spread = 2 * SAMPLES * apart, 2 * math.sqrt(SAMPLES * apart * (1 - apart))
    q, q2 = 1 - 2 / BITS, 1 - 4 / BITS
    mean = BITS / 2 * (1 - q**flips)
    own = BITS / 4 * (1 + (BITS - 1) * q2**flips - BITS * q ** (2 * flips))
    slope = -BITS / 2 * q**flips * math.log(q)
    return math.ceil(mean + deviations * math.sqrt(max(own, 0) + (slope * spread) ** 2))


def _described(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, mark, n, set, bands, sketch); the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, bands, sketches = [], [], [], []
            for text in batch["text"]:
                grams = gram_set(text.as_py(), size)
                sizes.append(len(grams))
                values = samples(grams) if len(grams) else None
                sets.append(None if values is None else xxhash.xxh128_digest(grams.tobytes()))
                bands.append(None if values is None else band_keys(values))
                sketches.append(None if values is None else sketch(values))
            found = {"n": pa.array(sizes, pa.int64()), "set": pa.array(sets, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())}
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("id", "mark")} | found)

    return run


def _fits(a: int, b: np.ndarray, similarity: int) -> np.ndarray:
    """Whether sets of these sizes can be at the similarity at all."""
    return 100 * np.minimum(a, b) >= similarity * np.maximum(a, b)


def _proposed(similarity: int, mode: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(src, dst, bits) of pairs within `left`, or between it and `right`, that sizes and sketches allow.

    mode least: of each node its least partner; nearest: its nearest partner of another component.
    """
    limit = most_bits(similarity)

    def read(column: pa.ListArray) -> tuple[np.ndarray, ...]:
        flat = column.flatten()
        values = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(len(flat), -1)
        return *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "component")), values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in range(batch.num_rows):
                right = batch["right"].slice(row, 1)
                alone = right.null_count == 1
                here = read(batch["left"].slice(row, 1))
                there = here if alone else read(right)
                for at in range(len(here[0])):
                    bits = np.bitwise_count(here[3][at] ^ there[3]).sum(1, dtype=np.int64)
                    fits = (bits <= limit) & _fits(int(here[1][at]), there[1], similarity)
                    if mode == "least":
                        fits &= there[0] < here[0][at]
                    else:
                        fits &= there[2] != here[2][at]
                    found = np.flatnonzero(fits)
                    if len(found) and mode == "least":
                        found = found[there[0][found].argmin()][None]
                    elif len(found):
                        found = found[np.lexsort((there[0][found], bits[found]))[:1]]
                    if len(found):
                        src.append(np.full(len(found), here[0][at]))
                        dst.append(there[0][found])
                        far.append(bits[found])
            yield pa.RecordBatch.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst), "bits": np.concatenate(far)})

    return run


@dataclass(frozen=True)
class _Piece:
    """The members of a chunk, as arrays."""

    chunk: int
    ids: np.ndarray
    n: np.ndarray
    component: np.ndarray
    sketch: np.ndarray
    bands: np.ndarray
    grams: list[np.ndarray] | None

    @staticmethod
    def read(column: pa.ListArray) -> _Piece:
        flat = column.flatten()
        ids, n, component = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "component"))
        words = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(len(flat), -1)
        bands = flat.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        grams = [np.frombuffer(g.as_buffer(), "<i8") for g in flat.field("grams")] if flat.type.get_field_index("grams") >= 0 else None
        return _Piece(flat.field("chunk")[0].as_py(), ids, n, component, words, bands, grams)

    def partners(self, at: int, there: _Piece, alone: bool, key: int, similarity: int, limit: int) -> np.ndarray:
        """Places of members of another component that sizes and sketches allow and that share no band before this one."""
        bits = np.bitwise_count(self.sketch[at] ^ there.sketch).sum(1, dtype=np.int64)
        fits = (bits <= limit) & _fits(int(self.n[at]), there.n, similarity) & (there.component != self.component[at])
        if alone:
            fits &= there.ids < self.ids[at]
        found = np.flatnonzero(fits)
        first = (there.bands[found] == self.bands[at]).argmax(1)
        return found[self.bands[at][first] == key]


def _held(batch: pa.RecordBatch) -> Iterator[tuple[int, _Piece, _Piece, bool]]:
    for row in range(batch.num_rows):
        right = batch["right"].slice(row, 1)
        alone = right.null_count == 1
        here = _Piece.read(batch["left"].slice(row, 1))
        yield batch["key"][row].as_py(), here, here if alone else _Piece.read(right), alone


def _waiting(similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, chunk, ids) of the members of each chunk of a meeting that have a partner to be confirmed in this bucket."""
    limit = most_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chunks, ids = [], [], []
            for key, here, there, alone in _held(batch):
                left, right = np.zeros(len(here.ids), bool), np.zeros(len(there.ids), bool)
                for at in range(len(here.ids)):
                    found = here.partners(at, there, alone, key, similarity, limit)
                    left[at] |= len(found) > 0
                    right[found] = True
                sides = ((here, left | right),) if alone else ((here, left), (there, right))
                for piece, some in sides:
                    if some.any():
                        keys.append(key)
                        chunks.append(piece.chunk)
                        ids.append(piece.ids[some])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "chunk": pa.array(chunks, pa.int32()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return run


def _joined(similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(src, dst): confirmed links that join the components of a meeting, whose members hold their sets."""
    limit = most_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, here, there, alone in _held(batch):
                parent: dict[int, int] = {}

                def root(x: int, parent: dict[int, int] = parent) -> int:
                    while (up := parent.get(x, x)) != x:
                        parent[x] = x = parent.get(up, up)
                    return x

                src, dst = [], []
                for at in range(len(here.ids)):
                    a = here.grams[at]
                    for other in here.partners(at, there, alone, key, similarity, limit):
                        if (p := root(int(here.component[at]))) == (q := root(int(there.component[other]))):
                            continue
                        b = there.grams[other]
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if 100 * both >= similarity * (len(a) + len(b) - both):
                            parent[p] = q
                            src.append(int(here.ids[at]))
                            dst.append(int(there.ids[other]))
                yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict({"node": batch["node"].slice(n, 1), "grams": pa.array([gram_set(batch["text"][n].as_py(), size).tobytes()], pa.binary())})

    return run


def _confirmed(similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["a"], batch["b"]):
                a, b = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


class Texts:
    """Finds the texts of nodes again: rows(id, mark, text) by places(node, id, mark), mark being a hash of the text."""

    def __init__(self, rows: DataFrame, places: DataFrame) -> None:
        self.rows, self.places = rows, places

    def sets(self, nodes: DataFrame, size: int) -> DataFrame:
        """(node, grams) of nodes(node), a node once however often its row comes."""
        wanted = cut(self.places.join(nodes, "node", "left_semi"))
        found = self.rows.join(_small(wanted, wanted.count()), ["id", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
        return written(found.mapInArrow(_sets(size), "node long, grams binary"))


def confirmed(pairs: DataFrame, texts: Texts, similarity: int, size: int) -> DataFrame:
    """The pairs(src, dst) of nodes whose full sets are at the similarity."""
    pairs = cut(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    grams = texts.sets(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), size)
    a, b = (grams.select(F.col("node").alias(end), F.col("grams").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return written(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(_confirmed(similarity), "src long, dst long"))


def _labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """rows(id, ...) with the component that the links give each id."""
    if links is None:
        return rows.withColumn("component", F.col("id"))
    found = components_of(links).select(F.col("node").alias("id"), "component")
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_links(nodes: DataFrame, texts: Texts, similarity: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(src, dst): confirmed links of nodes(id, n, bands, sketch) that join all nodes at the similarity."""
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").withColumn("pieces", F.ceil(F.col("many") / CHUNK))
    rows = keyed.join(counts, "key").select("key", "id", F.pmod(F.xxhash64("key", "id"), F.col("pieces")).cast("int").alias("chunk"))
    rows = written(rows.join(nodes.select("id", "n", "sketch"), "id"))
    schema = "src long, dst long, bits long"
    first = meetings(_labelled(rows, None), False, _SKETCHED).mapInArrow(_proposed(similarity, "least"), schema)
    links = confirmed(first.groupBy("src").agg(F.min("dst").alias("dst")), texts, similarity, size)
    open_ = open_rows(_labelled(rows, links))
    second = meetings(open_, True, _SKETCHED).mapInArrow(_proposed(similarity, "nearest"), schema)
    second = second.groupBy("src").agg(F.min(F.struct("bits", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst"))
    links = links.unionByName(confirmed(second, texts, similarity, size))
    open_ = open_rows(_labelled(open_.drop("component"), links))
    waiting = meetings(open_.join(nodes.select("id", "bands"), "id"), True, _SPANNED).mapInArrow(_waiting(similarity), "key long, chunk int, ids array<long>")
    # a member is listed once a bucket, however many chunks its own one met
    waiting = waiting.groupBy("key", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    waiting = written(open_.drop("chunk").join(waiting.select("key", F.explode("ids").alias("id")), ["key", "id"]))
    pieces = waiting.groupBy("key").agg(F.ceil(F.sum("n") / SHINGLES).alias("pieces"))
    grams = texts.sets(waiting.select(F.col("id").alias("node")).distinct(), size).withColumnRenamed("node", "id")
    last = waiting.join(pieces, "key").withColumn("chunk", F.pmod(F.xxhash64("key", "id"), F.col("pieces")).cast("int"))
    last = last.join(nodes.select("id", "bands"), "id").join(grams, "id")
    return written(links.unionByName(meetings(last, True, (*_SPANNED, "grams")).mapInArrow(_joined(similarity), "src long, dst long")))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component, kept) of every row: documents at the similarity (in hundredths) are linked, component is the least id."""
    text_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = texts.mapInArrow(_described(size), "id long, mark long, n long, set binary, bands array<long>, sketch binary")
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    sets = written(found.where("n > 0").groupBy("set").agg(F.min("row").alias("node"), F.min("id").alias("least")))
    nodes = written(found.join(sets.select(F.col("node").alias("row")), "row").select(F.col("row").alias("id"), F.col("id").alias("doc"), "mark", "n", "bands", "sketch"))
    places = nodes.select(F.col("id").alias("node"), F.col("doc").alias("id"), "mark")
    links = near_links(nodes, Texts(texts, places), similarity, size)
    component = components_of(links).select("node", F.col("component").alias("group"))
    groups = written(sets.join(component, "node", "left").select("set", "least", F.coalesce("group", "node").alias("group")))
    least = groups.groupBy("group").agg(F.min("least").alias("component"))
    of_set = written(groups.join(least, "group").select("set", "component"))
    rows = found.select("id", "n", "set").join(of_set, "set", "left").withColumn("component", F.coalesce("component", "id"))
    id_, component = (F.when(F.col(c) != _NO_ID, F.col(c)) for c in ("id", "component"))
    return rows.select(id_.alias("id"), "n", component.alias("component"), id_.eqNullSafe(component).alias("kept"))


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
b AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM b JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT r.x AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.y GROUP BY r.x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN c ON c.rid = w.rid LEFT JOIN n ON n.rid = w.rid"""
