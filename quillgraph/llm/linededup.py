"""Op 6: line dedup by a segment-partition edit join. DataFrame functions only.

An occurrence of a line is removed if an earlier occurrence (smaller id, or the same row and an earlier line) is equal
to it or, for lines of at least MIN_CHARS characters, within EDITS edits of it. Lines are judged on the input, not on
what is left; blank lines stay.

Equal lines are grouped first, by an md5, and each distinct line's first occurrence is written to a table together with
its segment keys. A line is cut into EDITS + 1 = 3 segments: the first w characters, the last w, and the middle; w comes
from the lower end of a class of lengths, so lines of one class are cut alike. Of two lines within two edits, one
segment has no edit: the first or the last segment is the same in both, or the middle is, moved by at most one
character, as the two segments around it then have one edit each. So a line has one key for each of the outer segments
and two for the middle (at its place and one character later), and again for the class below if a line two characters
shorter falls in it. Lines of lengths within two that share a key are pairs; their texts are read
again, and those whose letter counts two edits can explain are verified by a bit-parallel edit distance over a band of
2 * EDITS + 1 diagonals.

A key that over HOT lines share makes no pairs at once. Its lines meet its first line, and those within two edits of it
are decided (they are later lines, but remain as earlier lines of others). The others are cut once more: what is left of
a line without the shared segment is within two edits as well, so the keys of the rest, beside the first key, find all
the pairs again, in far smaller groups.

Defined cases: null and empty texts have no lines and come back as they are; null ids are one id that comes last;
rows that share an id are ordered by a 64-bit hash of the text, and equal rows are one document that is returned as
often as it comes; very long lines are lines like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.session import cut, written

EDITS = 2
MIN_CHARS = 24
HOT = 100
MAX_BROADCAST_LINES = 400_000
#: Counted in each line, 15 at most; the choice only decides how many pairs are left to verify.
LETTERS = (" ", "e", "a", "n", "t", "o", "i", "r", "s", "l", "d", "u", "c", "m", "g")
_LAST = 2**63 - 1
_HIGH = 0x0888888888888888
_LOW = 0x0777777777777777


def _class(size: Column) -> Column:
    """The lower end of the class of lengths that a length falls in; classes grow with the length."""
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(size.cast("long"))) - 3, F.lit(1)))
    return (size - size % width).cast("int")


def _segments(size: Column, low: Column) -> list[tuple[int, Column, Column]]:
    """(kind, start, width) of the segments of a line cut as in the class; kind 1 is the middle, at two places."""
    w = F.floor(low / 3).cast("int")
    return [(0, F.lit(0), w), (1, w, low - 2 * w - 1), (1, w + 1, low - 2 * w - 1), (2, size - w, w)]


def _classes(size: Column) -> tuple[Column, Column]:
    """The classes in which a line of this length and a line two characters shorter are cut."""
    return _class(size), _class(F.greatest(size - EDITS, F.lit(8)))


def segment_keys(line: Column) -> Column:
    """Array of the keys; plain expressions, which Spark compiles, as lambda functions take four times as long."""
    size = F.length(line)
    own, below = _classes(size)
    keys = [F.array(*[F.xxhash64(low, F.lit(kind), F.substring(line, start + 1, width)) for kind, start, width in _segments(size, low)]) for low in (own, below)]
    return F.array_distinct(F.concat(keys[0], F.when(own != below, keys[1]).otherwise(F.array().cast("array<bigint>"))))


def spans(line: Column) -> Column:
    """Array of (k, start, width): the keys with their segments' places."""
    size = F.length(line)
    out = []
    for low in _classes(size):
        for kind, start, width in _segments(size, low):
            key = F.xxhash64(low, F.lit(kind), F.substring(line, start + 1, width))
            out.append(F.struct(key.alias("k"), start.cast("int").alias("start"), width.cast("int").alias("width")))
    return F.array_distinct(F.array(*out))


def counts(line: Column) -> Column:
    """Letter counts modulo 16, four bits each."""
    out = F.lit(0).cast("long")
    for n, letter in enumerate(LETTERS):
        many = (F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))).cast("long").bitwiseAND(F.lit(15))
        out = out.bitwiseOR(F.shiftleft(many, 4 * n))
    return out


def difference(a: Column, b: Column) -> Column:
    """The least sum of count differences, all counts at once; what the modulus hides only lets more pairs pass."""
    high, low = F.lit(_HIGH), F.lit(_LOW)
    minus = (a.bitwiseOR(high) - b.bitwiseAND(low)).bitwiseXOR(a.bitwiseXOR(F.bitwise_not(b)).bitwiseAND(high))
    sign = F.shiftright(minus.bitwiseAND(high), 3)
    size = minus.bitwiseXOR(F.shiftleft(sign, 4) - sign) + sign
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0xFFFFFFFF)):
        size = size.bitwiseAND(F.lit(mask)) + F.shiftright(size, shift).bitwiseAND(F.lit(mask))
    return size


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of characters, whose sizes differ by at most `edits`, are within `edits` edits.

    The columns of the distance matrix are b's characters; of each column only the band of 2 * edits + 1 rows around
    the diagonal is kept, as two bit vectors of the +1 and -1 steps down the band (Myers' bit-parallel recurrence in its
    banded form). The band moves down one row each column; `score` is the distance at its last row. Steps along the band
    change it by one each, so over 3 * edits it can't come back, and the rest of b is passed over.
    """
    band = 2 * edits + 1
    full, top = (1 << band) - 1, 1 << (band - 1)
    size_a, size_b = F.size(a), F.size(b)

    def column(acc: Column, x: Column) -> Column:
        match = F.lit(0)
        for k in range(band):
            # bit k stands for row at - edits + k of a
            row = x["at"] - edits + k
            same = F.when((row >= 1) & (row <= size_a), F.get(a, row - 1) == x["char"]).otherwise(False)
            match = match.bitwiseOR(F.when(same, 1 << k).otherwise(0))
        return F.struct(match.alias("m"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["score"].alias("score"))

    def diagonal(x: Column) -> Column:
        d0 = (x["m"].bitwiseAND(x["vp"]) + x["vp"]).bitwiseXOR(x["vp"]).bitwiseOR(x["m"]).bitwiseOR(x["vn"]).bitwiseAND(F.lit(full))
        return F.struct(d0.alias("d0"), x["vp"].alias("vp"), x["vn"].alias("vn"), x["score"].alias("score"))

    def move(x: Column) -> Column:
        d0, vp = x["d0"], x["vp"]
        hp = x["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
        hn, down = d0.bitwiseAND(vp), F.shiftright(d0, 1)
        new_vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full)))
        score = x["score"] + F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
        return F.struct(new_vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

    def step(acc: Column, x: Column) -> Column:
        # one-element arrays bind what the next line uses more than once
        moved = F.get(F.transform(F.transform(F.array(column(acc, x)), diagonal), move), F.lit(0))
        return F.when(acc["score"] > 3 * edits, acc).otherwise(moved)

    start = F.struct(F.lit(((1 << edits + 1) - 1) << edits & full).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score"))
    chars = F.transform(b, lambda c, n: F.struct((n + 1).alias("at"), c.alias("char")))

    def finish(acc: Column) -> Column:
        total = acc["score"]
        for k in range(band - 2, -1, -1):
            # the step from row size_b + 1 - edits + k up; taken back if that row is below a's last
            beyond = size_b + 1 - edits + k > size_a
            delta = F.when(acc["vp"].bitwiseAND(F.lit(1 << k)) != 0, 1).when(acc["vn"].bitwiseAND(F.lit(1 << k)) != 0, -1).otherwise(0)
            total = total - F.when(beyond, delta).otherwise(0)
        return F.when(acc["score"] > 3 * edits, edits + 1).otherwise(total)

    return F.aggregate(chars, start, step, finish) <= edits


def near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two lines are within the edits; their characters are split once, as a lambda's variable."""
    both = F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")))
    verified = F.get(F.transform(both, lambda x: within_edits(x["a"], x["b"], edits)), F.lit(0))
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, verified).otherwise(False)


def _small(rows: DataFrame, many: int) -> DataFrame:
    return F.broadcast(rows) if many <= MAX_BROADCAST_LINES else rows


def _place(c: str) -> Column:
    return F.struct(*[F.col(f"{x}_{c}") for x in ("key", "copy", "n")])


def _lines_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, key, copy, n, line, counts) of wanted(id, key, copy, n), read from the documents."""
    wanted = cut(wanted)
    many = wanted.count()
    listed = wanted.groupBy("key", "copy").agg(F.collect_list(F.struct("n", "id")).alias("ns"))
    met = rows.dropDuplicates(["key", "copy"]) if "repeated" in rows.columns else rows
    met = met.join(_small(listed, many), ["key", "copy"])
    line = lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"), F.get(F.col("parts"), x["n"]).alias("line"))
    found = met.select("key", "copy", "ns", F.split("text", "\n", -1).alias("parts")).select("key", "copy", F.explode(F.transform("ns", line)).alias("x"))
    return cut(found.select("x.id", "key", "copy", "x.n", "x.line").withColumn("counts", counts(F.col("line"))))


def _side(lines: DataFrame, name: str, *more: str) -> DataFrame:
    return lines.select(*more, *[F.col(c).alias(f"{c}_{name}") for c in ("id", "key", "copy", "n", "counts", "line")])


def _later(pairs: DataFrame, edits: int) -> DataFrame:
    """Distinct ids of lines b of pairs with both lines that are within the edits of a."""
    # dealt by both ends, so that few tasks with many pairs of one line can't arise
    pairs = pairs.select("id_a", "id_b", "line_a", "line_b").repartition("id_a", "id_b")
    return pairs.where(near(F.col("line_a"), F.col("line_b"), edits)).select(F.col("id_b").alias("id")).distinct()


def _close(edits: int) -> Column:
    return difference(F.col("counts_a"), F.col("counts_b")) <= 2 * edits


def _hot_later(lines: DataFrame, hot: DataFrame, edits: int) -> DataFrame:
    """Ids of lines that share a hot key with an earlier line within the edits."""
    line = F.col("line")
    span = lines.select(*lines.columns, F.explode(spans(line)).alias("s")).withColumn("k", F.col("s.k"))
    rest = F.concat(F.substring(line, F.lit(1), F.col("s.start")), F.expr("substring(line, s.start + s.width + 1)"))
    rows = cut(span.join(hot, "k").select("k", *lines.columns, rest.alias("rest")).dropDuplicates(["k", "id", "rest"]))
    first = rows.groupBy("k").agg(F.min(F.struct("key", "copy", "n", "id", "counts", "line")).alias("f")).select("k", "f.*")
    pairs = rows.transform(_side, "b", "k").join(_side(first, "a", "k"), "k").where((F.col("id_a") != F.col("id_b")) & _close(edits))
    decided = cut(_later(pairs.dropDuplicates(["id_a", "id_b"]), edits))
    finer = cut(rows.select("k", "id", "key", "copy", "n", "counts", F.explode(segment_keys(F.col("rest"))).alias("k2")))
    a = finer.select("k", "k2", *[F.col(c).alias(f"{c}_a") for c in ("id", "key", "copy", "n", "counts")])
    b = finer.join(decided, "id", "left_anti").select("k", "k2", *[F.col(c).alias(f"{c}_b") for c in ("id", "key", "copy", "n", "counts")])
    pairs = a.join(b, ["k", "k2"]).where((_place("a") < _place("b")) & _close(edits)).select("id_a", "id_b").distinct()
    pairs = pairs.join(_side(lines, "a"), "id_a").join(_side(lines, "b"), "id_b")
    return decided.unionByName(_later(pairs, edits))


def later_lines(rows: DataFrame, first: DataFrame, edits: int = EDITS) -> DataFrame:
    """Ids of the distinct lines first(id, key, copy, n, size, keys) that are within the edits of an earlier one."""
    keyed = first.where("keys is not null").select("id", "size", F.explode("keys").alias("k"))
    hot = cut(keyed.groupBy("k").count().where(F.col("count") > HOT).select("k"))
    many = hot.count()
    cold = keyed.join(_small(hot, many), "k", "left_anti") if many else keyed
    a, b = (cold.select("k", F.col("id").alias(f"id_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    pairs = a.join(b, "k").where((F.col("id_a") < F.col("id_b")) & F.col("size_a").between(F.col("size_b") - edits, F.col("size_b") + edits)).select("id_a", "id_b")
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    if many:
        hot_ids = cut(keyed.join(_small(hot, many), "k", "left_semi").select("id").distinct())
        wanted = wanted.unionByName(hot_ids)
    lines = _lines_of(rows, first.join(wanted.distinct(), "id", "left_semi").select("id", "key", "copy", "n"))
    # ids don't follow the places: the later line of a pair is told by the places
    met = pairs.join(_side(lines, "a"), "id_a").join(_side(lines, "b"), "id_b").where(_close(edits))
    swapped = [F.when(_place("a") < _place("b"), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for c in ("id", "line") for x, y in (("a", "b"), ("b", "a"))]
    found = _later(met.select(*swapped), edits)
    if many:
        found = found.unionByName(_hot_later(lines.join(hot_ids, "id", "left_semi"), hot, edits))
    return cut(found.distinct())


def kept_lines(rows: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, copy, ns): the numbers of the lines that stay, of rows(key, copy, text)."""
    line = F.col("line")
    lines = rows.select("key", "copy", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(F.trim("line") != "")
    long = F.length(line) >= min_chars
    lines = lines.select(F.md5(line.cast("binary")).alias("h"), F.struct("key", "copy", "n").alias("p"), F.length(line).alias("size"), F.when(long, segment_keys(line)).alias("keys"))
    first = lines.groupBy("h").agg(F.min("p").alias("p"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    first = written(first.select(F.monotonically_increasing_id().alias("id"), "p.*", "size", "keys"))
    later = later_lines(rows, first, edits)
    return first.select("id", "key", "copy", "n").join(later, "id", "left_anti").groupBy("key", "copy").agg(F.collect_list("n").alias("ns"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc (all its other columns as a struct), text (what is left), n_lines, n_removed."""
    if edits != 2:
        raise ValueError("the segments are laid out for two edits")
    others = [c for c in docs.columns if c != text_col]
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))
    unique = docs.groupBy(key.alias("key")).count().where("count > 1").isEmpty()
    copy = F.lit(0).cast("long") if unique else F.xxhash64(F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`"))
    texts = docs.select(key.alias("key"), copy.alias("copy"), F.col(f"`{text_col}`").alias("text"))
    if not unique:
        texts = texts.withColumn("repeated", F.lit(True))
    if others == [id_col]:
        rows = texts.select("key", "copy", "text")
        doc = F.struct(F.when(F.col("key") != _LAST, F.col("key")).alias(id_col))
    else:
        rows = docs.select(key.alias("key"), copy.alias("copy"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"))
        doc = F.col("doc")
    kept = kept_lines(texts, edits, min_chars)
    met = rows.join(kept, ["key", "copy"], "left")
    mine = F.coalesce("ns", F.array().cast("array<int>"))

    def staying(x: Column) -> Column:
        blank = F.array_compact(F.transform(x["parts"], lambda line, n: F.when(F.trim(line) == "", n)))
        return F.struct(x["parts"].alias("parts"), F.array_sort(F.concat(x["mine"], blank)).alias("stay"))

    def joined(x: Column) -> Column:
        left = F.array_join(F.transform(x["stay"], lambda n: F.get(x["parts"], n)), "\n")
        n_lines = F.size(x["parts"]).cast("long")
        return F.struct(left.alias("text"), n_lines.alias("n_lines"), (n_lines - F.size(x["stay"])).alias("n_removed"))

    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    # lambdas bind the split lines, and explode() keeps filters on the result from evaluating it again
    split = F.array(F.struct(F.split("text", "\n", -1).alias("parts"), mine.alias("mine")))
    out = F.when(F.col("text").isNull(), F.array(nothing)).otherwise(F.transform(F.transform(split, staying), joined))
    return met.select(doc.alias("doc"), F.explode(out).alias("x")).select("doc", "x.text", "x.n_lines", "x.n_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "n_lines", "n_removed", "text")


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; documents that have no line left go, n_chars is of what is left."""
    rows = dedup_lines(docs).where("text is null or text <> '' or n_removed = 0")
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in docs.columns]
    return rows.select(*columns)
