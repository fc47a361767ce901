"""Op 12: phrase collocation mining with pivot partitioning.

Words are numbered from frequent to rare within the table. The pivot of an n-gram is its rarest word, the leftmost one
of several. Each occurrence of a word becomes one text fragment for the partition of this word: its neighbours up to
`longest - 1` words away, cut off at the first that is rarer (to the left also at the first equal one), as no n-gram
beyond it has this pivot. Equal fragments are counted before they are shuffled. A partition mines its fragments alone
and emits only n-grams that hold the pivot, so every occurrence of an n-gram is counted once, in one partition.

Partitions are (pivot, salt) pairs dealt into buckets of about LOAD fragments. A pivot with over UNIT occurrences is
split by a hash of the fragment; its counts are added up afterwards, so only other pivots' rare n-grams fall where they
are mined.

The numbers of the `listed` most frequent words travel to all tasks, at most MAX_LISTED of them, whatever the corpus. If
that is every word that reaches the least count, other words are in no frequent phrase and become gaps. If not, other
words take 62 bits of a hash as their number, after all listed ones; a seed is taken only if no two words of a language
share a number, so counts stay exact.

Scores are exact: floor(1000000 * a * a / (l * r)) by decimal integers.

Defined cases: a null text is empty, a null language is `und`; a phrase never crosses a separator; repeated rows count
each time; ties go by a and then by the phrase's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.session import text_batches, written

LEAST, LONGEST, TOP = 10, 3, 2000
ABSORBED = 50
MAX_LISTED = 1 << 19
LOAD, UNIT = 500_000, 100_000
FLUSH = 1 << 20
ENTRIES = 1 << 18
UNDEFINED = "und"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(_BREAKS, b"\n" * len(_BREAKS))
_RARE = 1 << 62


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece; only A-Z are lower-cased, only space and tab part words inside a piece."""
    data = (text or "").encode("utf-8", "replace").lower().translate(_TO_LINES)
    return [words for piece in data.split(b"\n") if (words := piece.split())]


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "word": _strings(list(counts)), "f": pa.array(list(counts.values()), pa.int64())})
        held.clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            counts = held.setdefault(lang.as_py(), Counter())
            for words in pieces(text.as_py()):
                counts.update(words)
        if sum(map(len, held.values())) > ENTRIES:
            yield from flush()
    yield from flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of texts(lang, text)."""
    return texts.select("lang", "text").mapInArrow(_counted, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _hash_id(seed: int) -> Column:
    """The number of a word that is not listed; `_Ids` does the same."""
    return F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{seed}:"), F.col("word"))), 1).bitwiseOR(F.lit(_RARE))


class _Ids(dict):
    """Word to number; words that are not listed get 0, or the hash number if there is a seed."""

    seed: int | None = None

    def __missing__(self, word: bytes) -> int:
        if self.seed is None:
            return 0
        return xxhash.xxh64_intdigest(b"%d:" % self.seed + word, 42) >> 1 | _RARE


class Listing:
    """The words that are listed: words(lang, id, word, f) from the most frequent on; rest has the others."""

    def __init__(self, freq: DataFrame, least: int, most: int) -> None:
        spark = freq.sparkSession
        place = F.floor(F.log2("f") * 16).alias("place")
        sizes = freq.where(F.col("f") >= least).groupBy(place).agg(F.count("*").alias("n"), F.min("f").alias("least"), F.sum("f").alias("words"))
        self.from_, self.words_in, listed = None, 0, 0
        complete = True
        for row in sizes.orderBy(F.desc("place")).collect():  # at most 16 rows for each doubling
            self.words_in += row.words
            complete = complete and (listed := listed + row.n) <= most
            if complete:
                self.from_ = row.least
        self.complete = complete
        top = freq.where(F.col("f") >= (self.from_ if self.from_ is not None else 2**62)).toArrow()
        top = top.sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")]).combine_chunks()
        self.table = top.append_column("id", pa.array(np.arange(1, len(top) + 1)))
        self.seed = None
        if not complete:
            others = freq.where(F.col("f") < self.from_) if self.from_ is not None else freq
            self.words_in = others.agg(F.sum("f")).first()[0] + sum(top["f"].to_pylist())
            for self.seed in range(100):
                self.rest = others.select("lang", _hash_id(self.seed).alias("id"), "word", "f")
                if self.rest.groupBy("lang", "id").count().where("count > 1").isEmpty():
                    break
        # the part of a pivot that is not listed: it has less than from_ occurrences
        self.rare_parts = 1 if complete else -(-(self.from_ or self.words_in) // UNIT)
        schema = "lang string, word string, f long, id long"
        self.words = spark.createDataFrame(self.table, schema) if len(top) else spark.createDataFrame([], schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.table.schema) as out:
            out.write_table(self.table)
        self.shared: Broadcast = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _listed(shared: Broadcast) -> pa.Table:
    return pa.ipc.open_stream(shared.value).read_all()


def windows(ids: np.ndarray, reach: int) -> np.ndarray:
    """(fragments, 2 * reach + 1): the pivot stands in the middle, 0 is a gap; fragments without a neighbour are left out.

    `ids` holds a 0 between pieces.
    """
    at = np.flatnonzero(ids) + reach
    padded = np.r_[np.zeros(reach, np.int64), ids, np.zeros(reach, np.int64)]
    pivot = padded[at]
    out = np.zeros((len(at), 2 * reach + 1), np.int64)
    out[:, reach] = pivot
    for side in (-1, 1):
        open_ = np.ones(len(at), bool)
        for far in range(1, reach + 1):
            other = padded[at + side * far]
            open_ &= (other > 0) & ((other < pivot) if side < 0 else (other <= pivot))
            out[:, reach + side * far] = np.where(open_, other, 0)
    return out[(out[:, reach - 1] > 0) | (out[:, reach + 1] > 0)]


def _mixed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _parts(pivots: np.ndarray, f: np.ndarray, rare: int) -> np.ndarray:
    """Over how many units a pivot is split; f has the counts of listed words by number."""
    if not len(f):
        return np.full(len(pivots), rare, np.int64)
    return np.where(pivots < _RARE, -(-f[np.minimum(pivots, len(f)) - 1] // UNIT), rare)


def _summed(rows: np.ndarray, counts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours in the order of `key` become one; others that are equal stay apart, which costs no count."""
    order = np.argsort(key, kind="stable")
    rows, counts, key = rows[order], counts[order], key[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
    return rows[new], np.add.reduceat(counts, new), key[new]


def _packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(np.c_[rows, counts].T).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: pa.Buffer) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(blob), "zstd").read()


def _fragments(shared: Broadcast, seed: int | None, rare: int, buckets: int, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _listed(shared)
        f = words["f"].to_numpy()
        ids: dict[str, _Ids] = {}
        for lang, word, id_ in zip(words["lang"].to_pylist(), words["word"].cast(pa.binary()).to_pylist(), words["id"].to_pylist()):
            ids.setdefault(lang, _Ids())[word] = id_
        del words
        held: dict[str, list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                rows = windows(np.array(found, np.int64), reach)
                if not len(rows):
                    continue
                h = _mixed(rows)
                pivots = np.ascontiguousarray(rows[:, reach])
                unit = pivots.view(np.uint64) + (h >> np.uint64(20)) % _parts(pivots, f, rare).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                bucket = (_mixed(unit[:, None]) + np.uint64(xxhash.xxh64_intdigest(lang) >> 1)) % np.uint64(buckets)
                rows, counts, key = _summed(rows, np.ones(len(rows), np.int64), bucket << np.uint64(36) | h >> np.uint64(28))
                bucket = (key >> np.uint64(36)).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                blobs = [_packed(rows[a:b], counts[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(rows)])]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(blobs), pa.string()), "bucket": pa.array(bucket[starts]), "fragments": pa.array(blobs, pa.binary())})
            held.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                numbers = ids.setdefault(lang.as_py(), _Ids())
                numbers.seed = seed
                get, found = numbers.__getitem__, held.setdefault(lang.as_py(), [])
                for piece in pieces(text.as_py()):
                    if len(piece) > 1:
                        found.extend(map(get, piece))
                        found.append(0)
            if sum(map(len, held.values())) > FLUSH:
                yield from flush()
        yield from flush()

    return run


def mined(rows: np.ndarray, counts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each length that hold the pivot of their fragment."""
    reach = longest - 1
    for size in range(2, longest + 1):
        grams, many = [], []
        for place in range(size):
            part = rows[:, reach - place : reach - place + size]
            full = (part > 0).all(1)
            grams.append(part[full])
            many.append(counts[full])
        grams, many = np.concatenate(grams), np.concatenate(many)
        if not len(grams):
            continue
        names, codes = np.unique(grams, return_inverse=True)
        codes = codes.reshape(grams.shape)
        key, top = codes[:, 0], len(names)
        for column in codes[:, 1:].T:
            if top > 2**62 // len(names):  # else a code passes 64 bits
                key = np.unique(key, return_inverse=True)[1]
                top = len(key)
            key, top = key * len(names) + column, top * len(names)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        yield grams[order[new]], np.add.reduceat(many[order], new)


def _mine(shared: Broadcast, rare: int, least: int, longest: int) -> Callable[[pa.Table], pa.Table]:
    def run(blobs: pa.Table) -> pa.Table:
        width = 2 * longest
        parts = [np.frombuffer(_unpacked(x.as_buffer()), np.int64).reshape(width, -1) for x in blobs["fragments"]]
        cells = np.concatenate(parts, axis=1).T
        rows, counts = np.ascontiguousarray(cells[:, :-1]), np.ascontiguousarray(cells[:, -1])
        f = _listed(shared)["f"].to_numpy()
        items, found = [], []
        for grams, many in mined(rows, counts, longest):
            keep = (many >= least) | (_parts(grams.max(1), f, rare) > 1)
            items += list(grams[keep])
            found.append(many[keep])
        offsets = np.r_[0, np.cumsum([len(x) for x in items])].astype(np.int32)
        flat = np.concatenate(items) if items else np.empty(0, np.int64)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
        return pa.table({"lang": pa.array([blobs["lang"][0].as_py()] * len(items), pa.string()), "items": listed, "a": pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())})

    return run


def frequent_grams(texts: DataFrame, listing: Listing, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, items, a): the n-grams of 2 to `longest` words with at least `least` occurrences."""
    buckets = max(1, -(-listing.words_in // LOAD))
    made = texts.select("lang", "text").mapInArrow(_fragments(listing.shared, listing.seed, listing.rare_parts, buckets, longest - 1), "lang string, bucket long, fragments binary")
    grams = made.groupBy("lang", "bucket").applyInArrow(_mine(listing.shared, listing.rare_parts, least, longest), "lang string, items array<long>, a long")
    return grams.groupBy("lang", "items").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _worded(grams: DataFrame, listing: Listing) -> DataFrame:
    """Adds words and word counts (arrays in the order of the items)."""
    single = grams.select("lang", "items", "a", F.posexplode("items").alias("at", "id"))
    named = single.join(F.broadcast(listing.words.select("lang", "id", "word", "f")), ["lang", "id"], "inner" if listing.complete else "left")
    if not listing.complete:
        other = listing.rest.select("lang", "id", F.col("word").alias("other"), F.col("f").alias("other_f"))
        known, unknown = named.where("word is not null"), named.where("word is null")
        named = known.unionByName(unknown.drop("word", "f").join(other.withColumnsRenamed({"other": "word", "other_f": "f"}), ["lang", "id"]))
    rows = named.groupBy("lang", "items", "a").agg(F.array_sort(F.collect_list(F.struct("at", "word", "f"))).alias("w"))
    return rows.select("lang", "items", "a", F.col("w.word").alias("words"), F.col("w.f").alias("counts"))


def top_rows(rows: DataFrame, by: list[str], order: list[Column], key: str, k: int) -> DataFrame:
    """The first k rows of each group with their rank; a large group is thinned out by salts first."""
    salt = F.pmod(F.xxhash64(key), F.lit(4096))
    for many in (4096, 64, 2, 1):
        window = Window.partitionBy(*by, F.pmod(salt, F.lit(many))) if many > 1 else Window.partitionBy(*by)
        rows = rows.withColumn("rank", F.row_number().over(window.orderBy(*order))).where(F.col("rank") <= k)
    return rows


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP, listed: int = MAX_LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first `top` phrases that no longer one absorbs."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNDEFINED)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    freq = written(word_counts(texts))
    listing = Listing(freq, least, listed)
    grams = written(_worded(frequent_grams(texts, listing, least, longest), listing))
    counted = grams.select("lang", F.col("items").alias("part"), F.col("a").alias("part_a"))
    size = F.size("items")
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.when(F.col("k") > 1, F.slice("items", F.lit(1), F.col("k")))).withColumn("right", F.when(F.col("k") < size - 1, F.slice("items", F.col("k") + 1, size - F.col("k"))))
    found = []
    for one_left, one_right in ((True, True), (True, False), (False, True), (False, False)):
        rows = cuts.where(F.col("left").isNull() if one_left else F.col("left").isNotNull()).where(F.col("right").isNull() if one_right else F.col("right").isNotNull())
        if longest < 4 - one_left - one_right:
            continue  # no such cut
        l, r = F.element_at("counts", 1).alias("l"), F.element_at("counts", -1).alias("r")
        if not one_left:
            rows = rows.join(counted.withColumnsRenamed({"part": "left", "part_a": "l"}), ["lang", "left"])
            l = F.col("l")
        if not one_right:
            rows = rows.join(counted.withColumnsRenamed({"part": "right", "part_a": "r"}), ["lang", "right"])
            r = F.col("r")
        found.append(rows.select("lang", "items", "words", "a", "k", l, r))
    cuts = found[0]
    for rows in found[1:]:
        cuts = cuts.unionByName(rows)
    score = F.expr("cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "items", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice(F.col("items"), s, m))))
    longer = grams.where(size > 2).select("lang", "a", F.explode(inner).alias("items")).groupBy("lang", "items").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "items"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    rows = top_rows(kept.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "c.l", "c.r", "c.score"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top)
    totals = freq.groupBy("lang").agg(F.sum("f").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM u GROUP BY lang),
b AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL),
t AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM t UNION ALL SELECT lang, y, z, f FROM t) GROUP BY ALL),
c AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM b JOIN u l ON l.lang = b.lang AND l.x = b.x JOIN u r ON r.lang = b.lang AND r.x = b.y LEFT JOIN m ON m.lang = b.lang AND m.x = b.x AND m.y = b.y
  WHERE b.f >= 10 AND 100 * coalesce(m.f, 0) < 50 * b.f
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f FROM t JOIN u l ON l.lang = t.lang AND l.x = t.x JOIN b r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f FROM t JOIN b l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN u r ON r.lang = t.lang AND r.x = t.z),
s AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o WHERE cut = 1)
SELECT f.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score FROM f JOIN n ON n.lang = f.lang WHERE rank <= 2000"""
