"""Op 9: document fingerprints by a randomised edit embedding.

A walk over a text's characters advances at time t past a character c if the shared random bit R[t, c] is set, and
writes c at every time it stands on it. Texts at a small edit distance fall into step again after an edit, so their
embeddings differ at few times: edit distance becomes Hamming distance. A fingerprint samples one bit of the embedded
character at SAMPLES times spread over [0, 2^level), level being the least one that spans the walk, and the same for
the two levels above, so that texts of up to four times the length can be compared at one level. Likeness is
2 * agreement - 1 over the times that either walk reaches, where a time that only one reaches counts as a coin toss.

`near_links` finds near fingerprints. Equal ones are one node. For a level and each gap up to the levels that likeness
accepts, BANDS samples of BAND_BITS bits are bucket keys, drawn from times that both walks reach whatever their length;
a walk has keys for another level only if its length lets it be alike to one there. Bucket rows are ids only. They are
sorted by key, and all pairs of a bucket are verified by their fingerprints; buckets over RUN are verified in place, by
pairs of chunks (simhash.shard_links). `near_groups` takes forests of such large buckets' links instead of all, by
rounds (_bucket_forest), and returns the components. A pair that meets in no band is not found: of pairs with a share s of equal bits,
1 - (1 - s ** BAND_BITS) ** BANDS are, 0.92 at the query's likeness LINKED (s = 0.9) and 0.999 at 0.9.

The query walks documents in descending doc_id: they are dealt into ranges of the id whose bounds are quantiles
(at most MAX_RANGES, each about RANGE_BYTES of text), sorted there and streamed, compressed by zstd until they are read; a copy of the next range's first
document follows each range, so no task sees a whole table and no text is collected.

Defined cases: null is the empty text, with the fingerprint of the empty text; likeness of two empty texts is 1, of an
empty and another text 0; likeness is 0 for texts over two levels apart; equal ids are ordered by a hash of the text; null ids come
last; a single document is its own next; repeated rows follow each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.simhash import _PAIR, CHUNK, _pairs, _runs, _small, components_of, shard_links
from quillgraph.llm.tables import table
from quillgraph.session import cut, written

SEED = 9
PERIOD = 4096
CLASSES = 256
SAMPLES = 256
LEVELS = 3
RANGE_BYTES = 4 << 20
MAX_RANGES = 4096
BANDS, BAND_BITS = 30, 24
NEAR = 0.5
LINKED = 0.8
RUN = 8
_NO_ID = 2**63 - 1
_FIRST = -(2**63)
_SLICE = 1 << 20


class Walker:
    """The shared random walk and its samples."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        steps = draw.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8).astype(bool)
        steps[:, -1] = True  # every character is left within a period
        # for each class and time: the time after the next one that advances, in the period
        times = np.arange(PERIOD)
        after = np.where(steps, times, PERIOD)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
        self.table = ((after + 1) % PERIOD).astype(np.uint16)
        shared = list(range(PERIOD))  # rows hold the same integers, so that a core's cache holds the rows of a text
        self.next = [[shared[n] for n in row.tolist()] for row in self.table]
        self.bits = draw.integers(0, 2, (SAMPLES, CLASSES), dtype=np.uint8)
        offsets = draw.random((64, SAMPLES))
        self._times = ((np.arange(SAMPLES) + offsets) * (2.0 ** np.arange(64)[:, None] / SAMPLES)).astype(np.int64)

    @staticmethod
    def classes(text: str) -> bytes:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()

    def walk(self, codes: bytes, start: int = 0) -> np.ndarray:
        """The time at which each character is left, from time `start` on."""
        rows, at = self.next, start % PERIOD
        if not codes:
            return np.empty(0, np.int64)
        points, full = np.frombuffer(codes, np.uint8), len(codes) // 4 * 4
        left = np.empty(len(codes), np.int64)
        # the loop takes four characters a step; where the walk stands between them follows for all steps at once
        for begin in range(0, full, _SLICE):
            end = min(begin + _SLICE, full)
            first = at
            steps = zip(*(codes[begin + n : end : 4] for n in range(4)))
            ends = np.array([at := rows[d][rows[c][rows[b][rows[a][at]]]] for a, b, c, d in steps], np.int64)
            before = np.concatenate([[first], ends[:-1]])
            for n in range(3):
                before = left[begin + n : end : 4] = self.table[points[begin + n : end : 4], before]
            left[begin + 3 : end : 4] = ends
        for n in range(full, len(codes)):
            at = left[n] = rows[codes[n]][at]
        stays = np.diff(left, prepend=start % PERIOD) % PERIOD
        stays[stays == 0] = PERIOD
        return start + np.cumsum(stays)

    def times(self, level: int) -> np.ndarray:
        return self._times[level]

    def sample(self, codes: np.ndarray, left: np.ndarray) -> str:
        """The fingerprint of a walk: its length, level and bits."""
        total = int(left[-1]) if len(left) else 0
        level = max(total - 1, 1).bit_length()
        at = np.searchsorted(left, self._times[level : level + LEVELS].ravel(), side="right")
        reached = np.flatnonzero(at < len(left))
        bits = np.zeros(LEVELS * SAMPLES, np.uint8)
        bits[reached] = self.bits[reached % SAMPLES, codes[at[reached]]]
        rows = np.packbits(bits.reshape(LEVELS, SAMPLES), axis=1)
        return f"{total:x}.{level:x}.{'.'.join(row.tobytes().hex() for row in rows)}"

    def fingerprint(self, text: str) -> str:
        codes = self.classes(text)
        return self.sample(np.frombuffer(codes, np.uint8), self.walk(codes))

    def likeness(self, a: str, b: str) -> float:
        (total_a, level_a, *rows_a), (total_b, level_b, *rows_b) = a.split("."), b.split(".")
        ta, tb, la, lb = int(total_a, 16), int(total_b, 16), int(level_a, 16), int(level_b, 16)
        if a == b:
            return 1.0
        level = max(la, lb)
        if abs(la - lb) >= LEVELS or not ta or not tb:
            return 0.0
        bits_a, bits_b = (np.unpackbits(np.frombuffer(bytes.fromhex(r[level - n]), np.uint8)) for r, n in ((rows_a, la), (rows_b, lb)))
        times = self.times(level)
        both, either = times < min(ta, tb), int((times < max(ta, tb)).sum())
        if not either:
            return 0.0
        same = int((bits_a[both] == bits_b[both]).sum())
        return max(0.0, 2 * (same + 0.5 * (either - int(both.sum()))) / either - 1.0)


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as (size, zstd), which the shuffle and its sort carry."""
    for batch in batches:
        raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch["text"]]
        packed = [pa.compress(x, codec="zstd", asbytes=True) for x in raw]
        rest = {c: batch[c] for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_pydict(rest | {"size": pa.array([len(x) for x in raw], pa.int64()), "packed": pa.array(packed, pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, bool]]:
    for batch in batches:
        for n in range(batch.num_rows):
            size = batch["size"][n].as_py()
            text = pa.decompress(batch["packed"][n].as_buffer(), size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""
            yield batch["bucket"][n].as_py(), batch["key"][n].as_py(), text, batch["extra"][n].as_py()


def _printed() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, out = Walker(), []
        held = None  # (bucket, key, text, codes, left, fingerprint) of the row that waits for its next
        for bucket, key, text, extra in _rows(batches):
            if held is not None and held[0] != bucket:
                held = None
            if held is None and extra:
                continue
            codes = walker.classes(text)
            left = walker.walk(codes)
            print_ = walker.sample(np.frombuffer(codes, np.uint8), left)
            if held is not None:
                _, old_key, old, old_codes, old_left, old_print = held
                half = len(old) // 2
                kept = len(old) - half
                new = old[:kept] + text[:half]
                tail = codes[:half]
                new_left = np.concatenate([old_left[:kept], walker.walk(tail, int(old_left[kept - 1]) if kept else 0)])
                new_print = walker.sample(np.frombuffer(old_codes[:kept] + tail, np.uint8), new_left)
                out.append((old_key, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), old_print, new_print, walker.likeness(old_print, new_print), walker.likeness(old_print, print_)))
            held = None if extra else (bucket, key, text, codes, left, print_)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    return run


def walk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edit with the next document, by descending id."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("key"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    ranges = max(1, min(MAX_RANGES, -(-size // RANGE_BYTES)))
    splits = rows.select("key").approxQuantile("key", [n / ranges for n in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    splits = sorted({int(x) for x in splits})
    # a range's number falls with the id: 0 holds the largest ids
    bucket = F.lit(len(splits)) - F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col("key"))) if splits else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    heads = sorted(rows.groupBy("bucket").agg(F.max("key")).collect())
    copies = [(key, heads[n - 1][0]) for n, (_, key) in enumerate(heads)]
    if not copies:
        copies = [(0, 0)]
    to = F.broadcast(docs.sparkSession.createDataFrame(copies, "key long, to int"))
    extra = rows.join(to, "key").select("key", "text", F.col("to").alias("bucket"), F.lit(True).alias("extra"))
    dealt = rows.select("key", "text", "bucket", F.lit(False).alias("extra")).unionByName(extra)
    order = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    dealt = dealt.select("key", "text", "bucket", "extra", order).mapInArrow(_compressed, "key long, bucket int, extra boolean, tie long, size long, packed binary")
    dealt = dealt.repartition(len(splits) + 1, "bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), "tie")
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.mapInArrow(_printed(), schema)
    return out.withColumn("key", F.when(F.col("key") != _FIRST, F.col("key"))).withColumnRenamed("key", "id")


_ROW = np.dtype([("total", "<i8"), ("level", "u1"), ("side", "u1"), ("bits", "u1", SAMPLES // 8)])
_SAME, _LONGER, _SHORTER = 0, 1, 2
#: (levels above its own at which a walk is sampled, gap to the other walk's level, side)
ROLES = [(0, 0, _SAME)] + [role for gap in range(1, LEVELS) for role in ((0, gap, _LONGER), (gap, gap, _SHORTER))]


def _band_count(gap: int, at_least: float) -> int:
    """Bands for texts `gap` levels apart: none if no likeness reaches the bound, one if only equal bits do."""
    least_share = (1 + at_least * (2.0 ** (gap - 1) if gap else 1.0)) / 2
    return 0 if least_share > 1 else 1 if least_share == 1 else BANDS


def _keyed(at_least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, id, role): the bucket keys of fingerprints; roles tell which of the levels a key was taken at, and the side."""
    draw = np.random.default_rng(SEED)
    # a walk of level n reaches the first half of the samples of level n, a quarter of those of level n + 1 and so on
    picks = [np.stack([draw.choice(SAMPLES >> gap + 1, BAND_BITS, replace=False) for _ in range(BANDS)]) for gap in range(LEVELS)]
    weights = 1 << np.arange(BAND_BITS, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                split = [x.split(".") for x in part["fingerprint"].to_pylist()]
                total = np.array([int(x[0], 16) for x in split], np.int64)
                level = np.array([int(x[1], 16) for x in split], np.int64)
                ids = part["id"].to_numpy()
                for role, (up, gap, side) in enumerate(ROLES):
                    count = _band_count(gap, at_least)
                    # alike walks reach at least this share of each other's times; a level apart, the power of two lies between them
                    edge = 2.0 ** (level if side == _SHORTER else level - 1)
                    near_edge = total * at_least <= edge * 2.0 ** (1 - gap) * 1.05 if side == _LONGER else total >= at_least * edge * 2.0 ** (gap - 1) * 0.95
                    walked = np.flatnonzero((total > 0) & ((side == _SAME) | near_edge))
                    if not count or not len(walked):
                        continue
                    bits = np.frombuffer(bytes.fromhex("".join(split[n][2 + up] for n in walked)), np.uint8).reshape(len(walked), -1)
                    keys = (np.unpackbits(bits, axis=1)[:, picks[gap][:count]] * weights).sum(2).astype(np.uint64)
                    shards = (((level[walked] + up)[:, None] * LEVELS + gap) * BANDS + np.arange(count)).astype(np.uint64)
                    h = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ ((shards + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
                    yield pa.RecordBatch.from_pydict({"h": pa.array(h.ravel().view(np.int64)), "id": pa.array(np.repeat(ids[walked], count)), "role": pa.array(np.full(h.size, role), pa.int32())})

    return run


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what _alike reads of a fingerprint in a role."""
    for batch in batches:
        rows = np.zeros(batch.num_rows, _ROW)
        for n, (text, role) in enumerate(zip(batch["fingerprint"].to_pylist(), batch["role"].to_pylist())):
            (total, level, *bits), (up, _, side) = text.split("."), ROLES[role]
            rows[n] = (int(total, 16), int(level, 16) + up, side, np.frombuffer(bytes.fromhex(bits[up]), np.uint8))
        yield pa.RecordBatch.from_pydict({"shard": pa.array(np.zeros(len(rows)), pa.int32()), "key": batch["h"], "id": batch["id"], "print": pa.array([x.tobytes() for x in rows], pa.binary())})


def _alike(at_least: float, spanning: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a bucket, or of two of its chunks, that are alike; with `spanning`, a forest that joins their components."""
    firsts = np.packbits(np.arange(SAMPLES) < np.arange(SAMPLES + 1)[:, None], axis=1).view(np.uint64)

    def read(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        component = flat.field("component" if spanning else "id").to_numpy()
        return flat.field("id").to_numpy(), np.frombuffer(b"".join(flat.field("print").to_pylist()), _ROW), component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in batches:
            for n in range(batch.num_rows):
                right = batch["right"].slice(n, 1)
                alone = right.null_count == 1
                ids, here, own = read(batch["left"].slice(n, 1))
                others, there, their = (ids, here, own[:0]) if alone else read(right)
                times = walker.times(int(here["level"][0]))
                reach = [np.searchsorted(times, x["total"], side="left") for x in (here, there)]
                bits = [np.ascontiguousarray(x["bits"]).view(np.uint64) for x in (here, there)]
                labels = np.unique(np.concatenate([own, their]), return_inverse=True)[1]
                src, dst = [], []
                for at in range(len(ids)):
                    past = at + 1 if alone else 0
                    both, either = np.minimum(reach[0][at], reach[1][past:]), np.maximum(reach[0][at], reach[1][past:])
                    apart = np.bitwise_count((bits[0][at] ^ bits[1][past:]) & firsts[both]).sum(1, dtype=np.int64)
                    # the same as Walker.likeness: equal bits, and half of those that only one reaches
                    like = 2 * (both - apart + 0.5 * (either - both)) / np.maximum(either, 1) - 1.0
                    sides = (here["side"][at] == _SAME) | (here["side"][at] != there["side"][past:])
                    found = np.flatnonzero(sides & (either > 0) & (like >= at_least))
                    if spanning and len(found):
                        new = labels[past if alone else len(ids) :][found]
                        found, new = found[new != labels[at]], new[new != labels[at]]
                        new, first = np.unique(new, return_index=True)
                        found = found[first]
                        labels[np.isin(labels, new)] = labels[at]
                    src += [int(ids[at])] * len(found)
                    dst += others[past:][found].tolist()
                yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _distinct(prints: DataFrame) -> DataFrame:
    least = F.min(F.coalesce(F.col("id"), F.lit(_NO_ID))).alias("least")
    # numbers of rows are shorter than hashes, and a bucket row is little else
    return cut(prints.groupBy("fingerprint").agg(least).withColumn("node", F.monotonically_increasing_id()))


def _run_links(keyed: DataFrame) -> DataFrame:
    """(src, dst) of all pairs of keyed(h, id) in one bucket, or (null, h) of a bucket over RUN; only h and id are shuffled."""
    rows = keyed.select("h", "id").repartition("h").sortWithinPartitions("h", "id")
    rows = rows.select("h", F.col("id").alias("component"), "id", F.lit(1 << 32 | 1).alias("place"))
    return cut(rows.mapInArrow(_runs(0.5, RUN, _pairs, _PAIR), "src long, dst long").distinct())


def _liked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walker = Walker()
    for batch in batches:
        like = [walker.likeness(a, b) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("src", "dst", "x", "y")} | {"likeness": pa.array(like, pa.float64())})


def _bucket_forest(rows: DataFrame, at_least: float) -> DataFrame:
    """(src, dst) that connect what links within the buckets of rows(shard, key, id, print), in two rounds.

    Buckets are dealt into chunks by a hash of key and id, so a group's members meet others in each band. Chunks are
    joined inside first. Chunks of one bucket then meet only if the bucket still holds several components, and give
    links between different ones alone: no link is lost, and a group that the first round joined costs nothing more.
    """
    links = _alike(at_least, True)
    counts = rows.groupBy("shard", "key").agg(F.ceil(F.count("*") / CHUNK).alias("pieces"))
    dealt = written(rows.join(counts, ["shard", "key"]).withColumn("chunk", F.pmod(F.xxhash64("key", "id"), F.col("pieces"))).drop("pieces"))
    packed = F.collect_list(F.struct("id", "print", "component"))
    nothing = F.lit(None).cast("array<struct<id:bigint,print:binary,component:bigint>>").alias("right")
    alone = dealt.withColumn("component", F.col("id")).groupBy("shard", "key", "chunk").agg(packed.alias("left")).where(F.size("left") > 1)
    inside = cut(alone.select("left", nothing).mapInArrow(links, "src long, dst long").distinct())
    joined = components_of(inside).select(F.col("node").alias("id"), "component")
    labelled = written(dealt.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    open_ = labelled.groupBy("shard", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("chunk").alias("last"))
    open_ = open_.where("a <> b and last > 0").select("shard", "key")
    pieces = written(labelled.join(open_, ["shard", "key"], "left_semi").groupBy("shard", "key", "chunk").agg(packed.alias("left")))
    other = pieces.select("shard", "key", F.col("chunk").alias("other"), F.col("left").alias("right"))
    met = pieces.join(other, ["shard", "key"]).where("chunk < other").select("left", "right")
    return inside.unionByName(met.mapInArrow(links, "src long, dst long"))


def _node_links(distinct: DataFrame, at_least: float, spanning: bool) -> DataFrame:
    """(src, dst, x, y, likeness) of linked nodes and their least ids."""
    keyed = distinct.select(F.col("node").alias("id"), "fingerprint").mapInArrow(_keyed(at_least), "h long, id long, role int")
    found = _run_links(keyed)
    pairs, hot = found.where("src is not null"), cut(found.where("src is null").select(F.col("dst").alias("h")))
    if many := hot.count():
        rows = keyed.join(_small(hot, many), "h", "left_semi").select("h", "id", "role").join(distinct.select(F.col("node").alias("id"), "fingerprint"), "id")
        rows = written(rows.select("h", "id", "role", "fingerprint").mapInArrow(_payload, "shard int, key long, id long, print binary"))
        pairs = pairs.unionByName(_bucket_forest(rows, at_least) if spanning else shard_links(rows, _alike(at_least, False)))
    pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a = distinct.select(F.col("node").alias("src"), F.col("fingerprint").alias("a"), F.col("least").alias("x"))
    b = distinct.select(F.col("node").alias("dst"), F.col("fingerprint").alias("b"), F.col("least").alias("y"))
    liked = pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b", "x", "y").mapInArrow(_liked, "src long, dst long, x long, y long, likeness double")
    return liked.where(F.col("likeness") >= at_least)


def near_links(prints: DataFrame, at_least: float = NEAR) -> DataFrame:
    """(src, dst, likeness) of prints(id, fingerprint): all pairs of fingerprints in a bucket that are alike.

    Ends are the least ids of their fingerprints, the larger one first, null ids last; copies are linked to that id.
    """
    distinct = _distinct(prints)
    links = _node_links(distinct, at_least, False).select("x", "y", "likeness")
    ids = prints.select(F.coalesce(F.col("id"), F.lit(_NO_ID)).alias("x"), "fingerprint")
    copies = ids.join(distinct, "fingerprint").where("x <> least").select("x", F.col("least").alias("y"), F.lit(1.0).alias("likeness"))
    src, dst = F.greatest("x", "y"), F.least("x", "y")
    return links.unionByName(copies).select(F.when(src != _NO_ID, src).alias("src"), F.when(dst != _NO_ID, dst).alias("dst"), "likeness")


def near_groups(prints: DataFrame, at_least: float = NEAR) -> DataFrame:
    """(fingerprint, near_group) of each fingerprint: the least id that links lead to; null if all ids are null."""
    distinct = _distinct(prints)
    found = components_of(cut(_node_links(distinct, at_least, True).select("src", "dst")))
    known = distinct.join(found, "node", "left").select("fingerprint", "least", F.coalesce("component", "node").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("first"))
    return known.join(least, "component").select("fingerprint", F.when(F.col("first") != _NO_ID, F.col("first")).alias("near_group"))


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(walk_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
    groups = near_groups(rows.select("id", "fingerprint"), LINKED)
    return rows.join(groups, "fingerprint").select(F.col("id").alias("doc_id"), *[c for c in rows.columns if c != "id"], "near_group")
