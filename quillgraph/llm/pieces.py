"""Op 8: SentencePiece encoding and decoding by a streaming Viterbi.

The lattice has a node at each character boundary and an arc for each piece of the vocabulary. Scores of a unigram
model add up and the best path to a node survives. In a BPE model a path is admissible if merging any two neighbours
anew gives the same two pieces; exactly one admissible path reaches a node that any reaches, so it is the survivor, and
the path to the end is the library's own encoding. A node needs only the survivors of the last `longest` nodes
(the maximum piece length); whenever all of these trace back to one boundary, the ids before it are committed and
forgotten. No piece has a word mark after another character, so the paths always converge before a word mark; words
are therefore encoded one at a time, and their ids are kept in a cache of bounded size. A text without word marks is
held as a window only.

Characters without a piece become UTF-8 byte pieces (or the unknown id if there are none) and no piece crosses them.

Defined cases: null and empty texts have no ids and decode to the empty text (null comes back as null); blanks,
repeated blanks and very long words are encoded like any other; a U+2581 in a text decodes to a blank, as in the
library, so such a text has round_trip false; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.session import text_batches

MARK = "▁"
CACHE = 250_000
_CONVERGE_EVERY = 64
_CUT = "\x1f"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores; small enough to travel with a task."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unknown: int, unigram: bool) -> None:
        self.pieces, self.special, self.byte_ids, self.unknown, self.unigram = pieces, special, byte_ids, unknown, unigram
        skipped = special | set(byte_ids.values())
        self.ids = {p: n for n, p in enumerate(pieces) if n not in skipped}
        self.scores = {p: scores[n] for p, n in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        pieces = [model.id_to_piece(n) for n in ids]
        special = {n for n in ids if model.is_control(n) or model.is_unknown(n) or model.is_unused(n)}
        byte_ids = {int(pieces[n][3:5], 16): n for n in ids if model.is_byte(n)}
        scores = [model.get_score(n) for n in ids]
        # a BPE model's scores are negated ranks
        ranks = [s for n, s in enumerate(scores) if n not in special and n not in byte_ids.values()]
        return cls(pieces, scores, special, byte_ids, model.unk_id(), not all(s == int(s) for s in ranks))


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.fits: dict[tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merges the neighbours of the best score, leftmost first, until none is a piece."""
        parts, scores = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for n in range(len(parts) - 1):
                score = scores.get(parts[n] + parts[n + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, n
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _admissible(self, before: str, piece: str) -> bool:
        known = self.fits.get((before, piece))
        if known is None:
            if len(self.fits) >= 2 * CACHE:
                self.fits.clear()
            known = self.fits[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def ids_of(self, char: str) -> list[int]:
        if char in self.v.ids:
            return [self.v.ids[char]]
        encoded = char.encode("utf-8", "surrogatepass")
        return [self.v.byte_ids[b] for b in encoded] if self.v.byte_ids else [self.v.unknown]

    def stream(self, chars: Iterator[str]) -> Iterator[list[int]]:
        """Ids of a normalised text in parts, as they are committed."""
        pieces, scores, longest, unigram = self.v.ids, self.v.scores, self.v.longest, self.v.unigram
        window, base, end = "", 0, 0  # window starts at boundary base
        # boundary -> (boundary before, piece, score); the piece is "" at the start and after a committed unknown
        nodes: dict[int, tuple[int, str, float]] = {0: (-1, "", 0.0)}
        for char in chars:
            window, end = window + char, end + 1
            if char not in pieces:
                # no piece crosses it: every path goes through the boundaries around it
                yield self._path(nodes, end - 1) + self.ids_of(char)
                nodes, window, base = {end: (-1, "", 0.0)}, "", end
                continue
            best = None
            for length in range(min(longest, end - base), 0, -1):
                start = end - length
                if start not in nodes or (piece := window[start - base :]) not in pieces:
                    continue
                before = nodes[start]
                if unigram:
                    if best is None or before[2] + scores[piece] > best[2]:
                        best = (start, piece, before[2] + scores[piece])
                elif self._admissible(before[1], piece) if before[1] else self._admissible("", piece):
                    best = (start, piece, 0.0)
                    break
            if best is not None:
                nodes[end] = best
            if end - base >= 2 * longest + _CONVERGE_EVERY:
                live = [n for n in nodes if n > end - longest]
                common = self._common(nodes, live)
                if common > base:
                    yield self._path(nodes, common)
                    head = nodes[common]
                    nodes = {n: x for n, x in nodes.items() if n > common}
                    nodes[common] = (-1, head[1], head[2])
                    window, base = window[common - base :], common
        yield self._path(nodes, end)

    @staticmethod
    def _common(nodes: dict[int, tuple[int, str, float]], live: list[int]) -> int:
        """The last boundary on the paths to all live nodes."""
        front = set(live)
        while len(front) > 1:
            last = max(front)
            front.remove(last)
            if nodes[last][0] < 0:
                return last
            front.add(nodes[last][0])
        return front.pop() if front else -1

    def _path(self, nodes: dict[int, tuple[int, str, float]], end: int) -> list[int]:
        out = []
        while nodes[end][0] >= 0:
            out.append(self.v.ids[nodes[end][1]])
            end = nodes[end][0]
        return out[::-1]

    def short(self, text: str) -> list[int]:
        """The same lattice, arcs taken forwards, for a text that is shorter than the window."""
        pieces, scores, starts, unigram, fits = self.v.ids, self.v.scores, self.v.starts, self.v.unigram, self.fits
        size = len(text)
        last: list[str | None] = [None] * (size + 1)
        totals = [0.0] * (size + 1)
        last[0] = ""
        for start in range(size):
            before = last[start]
            if before is None:
                continue
            if text[start] not in pieces:
                last[start + 1], totals[start + 1] = "", totals[start]
                continue
            for end in range(start + 1, size + 1):
                piece = text[start:end]
                if piece not in starts:
                    break
                if piece not in pieces:
                    continue
                if unigram:
                    if last[end] is None or totals[start] + scores[piece] > totals[end]:
                        last[end], totals[end] = piece, totals[start] + scores[piece]
                elif last[end] is None:
                    known = fits.get((before, piece))
                    if self._admissible(before, piece) if known is None else known:
                        last[end] = piece
        out: list[int] = []
        end = size
        while end:
            piece = last[end]
            if piece:
                out.append(pieces[piece])
                end -= len(piece)
            else:
                end -= 1
                out += self.ids_of(text[end])[::-1]
        return out[::-1]

    def _segment(self, segment: str) -> bytes:
        found = self.old.get(segment)
        if found is None:
            ids = self.short(segment) if len(segment) <= 4 * self.v.longest else [n for part in self.stream(iter(segment)) for n in part]
            found = np.array(ids, "<i4").tobytes()
        if len(segment) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[segment] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or _CUT in marked:
            segments = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+", marked)
        else:
            segments = marked.replace(MARK, _CUT + MARK).replace("\n", _CUT + "\n").split(_CUT)[1:]
        young, segment = self.young, self._segment
        out = []
        for s in segments:
            found = young.get(s)
            if found is None:
                found = segment(s)
                young = self.young
            out.append(found)
        return b"".join(out)


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        values = {i: bytes([b]) for b, i in vocabulary.byte_ids.items()}
        special = dict.fromkeys(vocabulary.special, b"") | {vocabulary.unknown: " ⁇ ".encode()}
        self.pieces = [values.get(n, special.get(n, p.replace(MARK, " ").encode())) for n, p in enumerate(vocabulary.pieces)]

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.pieces
        return b"".join([pieces[n] for n in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


#: The encoder of this Python worker, which runs many tasks: words that one task met are known to the next.
_ENCODER: list[Encoder] = []


def worker_encoder(vocabulary: Vocabulary) -> Encoder:
    if not _ENCODER or _ENCODER[0].v.pieces != vocabulary.pieces or _ENCODER[0].v.scores != vocabulary.scores:
        _ENCODER[:] = [Encoder(vocabulary)]
    return _ENCODER[0]


def _encoded(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                raw, same = [], []
                for text in part["text"].to_pylist():
                    raw.append(encoder.encode(text or ""))
                    same.append(decoder.decode(np.frombuffer(raw[-1], "<i4")) == (text or ""))
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in raw])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_pydict({"id": part["id"], "n_ids": pa.array(np.diff(offsets), pa.int32()), "ids": ids, "round_trip": pa.array(same, pa.bool_())})

    return run


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids, round_trip) of every row; the driver reads the model's file, executors get its pieces."""
    text_batches(docs.sparkSession)
    vocabulary = Vocabulary.load(model or default_model())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(vocabulary), "id long, n_ids int, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(id, text) of rows(id, ids)."""
    vocabulary = Vocabulary.load(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "text": pa.array(texts, pa.string())})

    return rows.select(F.col("id").cast("long"), "ids").mapInArrow(run, "id long, text string")


def op8_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip)."""
    return encode(docs).withColumnRenamed("id", "doc_id")
