"""Op 11: fill-in-middle transformation by a parallel automaton scan.

An automaton over the bytes of a text tells where units (lines, by default) begin. A chunk of bytes is a function: for
each state at its start the state at its end and the number of units that begin in it. Such functions compose
associatively, so chunks are scanned side by side and a prefix composition then gives the state in which each is
entered and the units before it. A cut after k units is looked up in the only chunk in which unit k + 1 begins.

Texts of up to `giant` bytes are scanned in the task that reads them, all texts of a batch at once, in blocks of BLOCK
bytes: nothing is shuffled. Larger texts are cut into chunks of `chunk` bytes that are dealt over all tasks; their
functions (a few numbers each) are composed by text, the chunks that hold a cut find it, and the two cuts travel back
to the text. Both ways give the same cuts.

Two draws from a hash of seed and id, modulo n + 1, give the two cuts; further draws choose whether the document is
transformed at all and the order of its parts. A text that holds one of the marks stays plain, as it could not be told
from an output.

Defined cases: a null text is empty; an empty text is plain with n = 0; a null id draws like an empty one; rows of one id
share their draws, and equal rows are transformed alike and returned as often as they come; an empty table gives an empty
result; other columns are handed through in `doc`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.session import text_batches, written

SEED = 7
RATE, SPM = 100, 50
BLOCK = 128
CHUNK = 1 << 20
GIANT = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Automaton:
    """classes: of each of the 256 bytes; steps and begins: by class and state, the next state and whether a unit begins with this byte.

    State 0 is the one in which a text starts; the first byte of a text must begin a unit there.
    """

    classes: tuple[int, ...]
    steps: tuple[tuple[int, ...], ...]
    begins: tuple[tuple[int, ...], ...]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three as arrays, with one more class that leaves the state and begins nothing, for padding."""
        states = len(self.steps[0])
        steps = np.array([*self.steps, tuple(range(states))], np.intp)
        begins = np.array([*self.begins, (0,) * states], np.int64)
        return np.array(self.classes, np.uint8), steps.ravel(), begins.ravel()


#: Lines, each with its line end. States: between lines, inside a line.
LINES = Automaton(tuple(int(b == 10) for b in range(256)), ((1, 1), (0, 0)), ((1, 0), (1, 0)))
#: Words, each with the white space after it; white space before the first word is a unit. States: start, space, word.
WORDS = Automaton(tuple(int(b in b" \t\n\x0b\x0c\r") for b in range(256)), ((2, 2, 2), (1, 1, 1)), ((1, 1, 0), (1, 0, 0)))


class Scan:
    """Texts as blocks: data are their bytes one after another, ends where each text ends."""

    def __init__(self, automaton: Automaton, data: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> None:
        classes, self.steps, self.begins = automaton.tables()
        self.states, self.block = len(automaton.steps[0]), block
        self.data, self.ends = data, ends.astype(np.int64)
        starts = np.r_[0, self.ends[:-1]].astype(np.int64)[: len(self.ends)]
        sizes = self.ends - starts
        self.starts, many = starts, -(-sizes // block)
        self.last = np.cumsum(many)
        self.first = self.last - many
        self.owner = np.repeat(np.arange(len(sizes)), many)
        cells = np.full(int(many.sum()) * block, len(automaton.steps), np.uint8)
        cells[np.arange(len(data)) + np.repeat(self.first * block - starts, sizes)] = classes[data]
        self.cells = np.ascontiguousarray(cells.reshape(-1, block).T)
        self.at = starts[self.owner] + (np.arange(len(self.owner)) - self.first[self.owner]) * block

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, states): the end state and the number of units that begin, by start state."""
        ends = np.tile(np.arange(self.states, dtype=np.intp), (self.cells.shape[1], 1))
        counts = np.zeros(ends.shape, np.int64)
        for column in self.cells:
            index = (column.astype(np.intp) * self.states)[:, None] + ends
            counts += self.begins[index]
            ends = self.steps[index]
        return ends, counts

    def entered(self, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each block the state in which it is entered and the units before it; of each text its units."""
        done, units = composed(ends, counts, self.first[self.owner])
        state, before = _entries(done, units, self.first[self.owner])
        total = np.zeros(len(self.ends), np.int64)
        some = self.last > self.first
        total[some] = units[self.last[some] - 1, 0]
        return state, before, total

    def find(self, blocks: np.ndarray, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The byte at which unit `wanted` (from 1) of a block begins if the block is entered in its state."""
        found, seen, state = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64), states.astype(np.intp)
        for at, column in enumerate(self.cells[:, blocks]):
            index = column.astype(np.intp) * self.states + state
            new = self.begins[index]
            seen += new
            found[(new > 0) & (seen == wanted)] = at
            state = self.steps[index]
        return self.at[blocks] + found

    def cuts(self, k: np.ndarray, state: np.ndarray, before: np.ndarray, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The byte after k[i] units of text i, for each text."""
        out = np.where(k <= 0, self.starts, self.ends)
        inside = np.flatnonzero((k > 0) & (k < total))
        own = counts[np.arange(len(state)), state]
        base = np.cumsum(total) - total
        upto = base[self.owner] + before + own
        blocks = np.searchsorted(upto, base[inside] + k[inside], side="right")
        out[inside] = self.find(blocks, state[blocks], k[inside] - before[blocks] + 1)
        return out


def composed(ends: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix composition of functions by doubling: row i becomes first[i], ..., i one after another."""
    ends, counts, n = ends.copy(), counts.copy(), np.arange(len(ends))
    step = 1
    while (far := np.flatnonzero(n - step >= first)).size:
        left, right = ends[far - step], ends[far]
        counts[far] = counts[far - step] + np.take_along_axis(counts[far], left, 1)
        ends[far] = np.take_along_axis(right, left, 1)
        step *= 2
    return ends, counts


def _entries(ends: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and units before each row of a prefix composition that starts in state 0."""
    inner = np.arange(len(ends)) > first
    state, before = np.zeros(len(ends), np.intp), np.zeros(len(ends), np.int64)
    at = np.flatnonzero(inner)
    state[at], before[at] = ends[at - 1, 0], counts[at - 1, 0]
    return state, before


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _chars(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and before the end."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)]


def located(automaton: Automaton, texts: pa.Array, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its units n and the code points before the cuts after the smaller and the larger of x % (n + 1), y % (n + 1)."""
    data, ends = _bytes(texts)
    scan = Scan(automaton, data, ends)
    done, counts = scan.functions()
    state, before, total = scan.entered(done, counts)
    chars = _chars(data)
    k = np.sort(np.stack([x % (total + 1), y % (total + 1)]), axis=0)
    a, b = (chars[scan.cuts(row, state, before, counts, total)] - chars[scan.starts] for row in k)
    return total, a, b


def _cut_udf(automaton: Automaton) -> Callable[..., Column]:
    @F.arrow_udf("n long, a long, b long")
    def cut_at(text: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        n, a, b = located(automaton, text, x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(a), pa.array(b)], ["n", "a", "b"])

    return cut_at


def _chunked(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                data = memoryview(batch["text"][n].as_buffer())
                for at, start in enumerate(range(0, len(data), size)):
                    piece = pa.array([bytes(data[start : start + size])], pa.binary())
                    yield pa.RecordBatch.from_pydict({c: batch[c].slice(n, 1) for c in ("key", "x", "y")} | {"chunk": pa.array([at], pa.int32()), "piece": piece})

    return run


def _one(piece: pa.Scalar) -> np.ndarray:
    return np.frombuffer(piece.as_buffer(), np.uint8)


def _summed(automaton: Automaton) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of each chunk, and its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, counts, chars = [], [], []
            for piece in batch["piece"]:
                data = _one(piece)
                scan = Scan(automaton, data, np.array([len(data)]))
                done, units = composed(*scan.functions(), np.zeros(scan.cells.shape[1], np.int64))
                ends.append(done[-1].tolist())
                counts.append(units[-1].tolist())
                chars.append(int(((data & 0xC0) != 0x80).sum()))
            found = {"ends": pa.array(ends, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64())), "chars": pa.array(chars, pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("key", "x", "y", "chunk")} | found)

    return run


def _selected(rows: pa.Table) -> pa.Table:
    """Composes the functions of one text's chunks: (key, n, cut, chunk, state, wanted, chars) of its two cuts.

    wanted is the unit of the chunk that begins at the cut; 0 where the cut is before the chunk, -1 where it is after it.
    """
    rows = rows.sort_by("chunk")
    ends, counts = np.array(rows["ends"].to_pylist(), np.intp), np.array(rows["counts"].to_pylist(), np.int64)
    first = np.zeros(len(ends), np.int64)
    done, units = composed(ends, counts, first)
    state, before = _entries(done, units, first)
    total = int(units[-1, 0])
    chars = rows["chars"].to_numpy()
    ahead = np.cumsum(chars) - chars
    out = []
    for cut, k in enumerate(sorted(int(rows[c][0].as_py()) % (total + 1) for c in ("x", "y"))):
        if k == 0 or k == total:
            at, wanted = (0, 0) if k == 0 else (len(ends) - 1, -1)
        else:
            at = int(np.searchsorted(before + counts[np.arange(len(ends)), state], k, side="right"))
            wanted = k - int(before[at]) + 1
        out.append((rows["key"][0].as_py(), total, cut, at, int(state[at]), wanted, int(ahead[at])))
    names = ("key", "n", "cut", "chunk", "state", "wanted", "chars")
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(zip(names, kinds))})


def _placed(automaton: Automaton) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The code points before a cut, from the chunk that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for piece, state, wanted, ahead in zip(batch["piece"], batch["state"].to_pylist(), batch["wanted"].to_pylist(), batch["chars"].to_pylist()):
                data = _one(piece)
                place = 0 if wanted == 0 else len(data)
                if wanted > 0:
                    scan = Scan(automaton, data, np.array([len(data)]))
                    done, counts = scan.functions()
                    done, units = composed(done, counts, np.zeros(len(done), np.int64))
                    # as above, but from the state in which this chunk is entered
                    block = int(np.searchsorted(units[:, state], wanted, side="left"))
                    inner, past = (int(done[block - 1, state]), int(units[block - 1, state])) if block else (state, 0)
                    place = int(scan.find(np.array([block]), np.array([inner]), np.array([wanted - past]))[0])
                at.append(ahead + int(((data[:place] & 0xC0) != 0x80).sum()))
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("key", "n", "cut")} | {"at": pa.array(at, pa.int64())})

    return run


def _giant_cuts(rows: DataFrame, automaton: Automaton, chunk: int) -> DataFrame:
    """(key, n, a, b) of rows(key, text, x, y), a key once."""
    pieces = rows.dropDuplicates(["key"]).mapInArrow(_chunked(chunk), "key string, x long, y long, chunk int, piece binary")
    pieces = written(pieces.repartition("key", "chunk"))
    sums = pieces.mapInArrow(_summed(automaton), "key string, x long, y long, chunk int, ends array<int>, counts array<long>, chars long")
    chosen = sums.groupBy("key").applyInArrow(_selected, "key string, n long, cut int, chunk int, state int, wanted long, chars long")
    at = pieces.select("key", "chunk", "piece").join(chosen, ["key", "chunk"]).mapInArrow(_placed(automaton), "key string, n long, cut int, at long")
    return at.groupBy("key").agg(F.first("n").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))


def draw(seed: int, id_: Column, n: int) -> Column:
    """The n-th (from 0) 8-digit group of the hex sha256 of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, automaton: Automaton = LINES, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output) of every row; doc has all its columns as a struct."""
    text_batches(docs.sparkSession)
    text, own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"), *[draw(seed, own, n).alias(name) for n, name in enumerate("xyuv")])
    small, large = (rows.where(kept) for kept in (F.octet_length("text") <= giant, F.octet_length("text") > giant))
    cut_at = _cut_udf(automaton)(F.col("text"), F.col("x"), F.col("y"))
    columns = ["doc", "text", "u", "v"]
    small = small.withColumn("cuts", cut_at).select(*columns, "cuts.n", "cuts.a", "cuts.b")
    keyed = large.withColumn("key", F.sha2(F.concat_ws(":", "x", "y", "text"), 256))
    cuts = _giant_cuts(keyed.select("key", "text", "x", "y"), automaton, chunk)
    large = keyed.join(cuts, "key").select(*columns, "n", "a", "b")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (F.col("u") % 100 >= rate), "plain").when(F.col("v") % 100 < spm, "spm").otherwise("psm")
    rows = small.unionByName(large).withColumn("form", form)
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a)
    suffix = F.substr("text", b + 1)
    plain = F.col("form") == "plain"
    output = F.when(plain, F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return rows.select("doc", "n", "form", F.when(~plain, F.col("a")).alias("prefix_chars"), F.when(~plain, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form."""
    one, two = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    second, third = F.instr(output, two), F.instr(output, F.lit(MIDDLE))
    head = F.substr(output, F.length(one) + 1, second - F.length(one) - 1)
    tail, middle = F.substr(output, second + 3, third - second - 3), F.substr(output, third + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
             WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
s AS (SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS i, strpos(output, '<M>') AS j FROM o),
x AS (SELECT *, substr(output, 4, i - 4) AS one, substr(output, i + 3, j - i - 3) AS two, substr(output, j + 3) AS three FROM s)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || three || two ELSE two || three || one END) AS restored_sha256
FROM x"""
