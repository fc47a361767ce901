"""Op 1: suffix-array dedup of repeated byte strings, sorted deep-shallow.

Every byte covered by a WINDOW-byte string that also starts earlier (smaller id, or same document and earlier start) is
removed. Sorting all suffixes of a corpus is not needed for that: in every window the GRAM-byte substring of least hash
is its anchor, so equal windows have equal anchors at equal offsets, and only suffixes at anchors that occur more than
once are sorted. The steps, all between blocks of documents and buckets of hashes:

1. each block asks the buckets which of its distinct anchor hashes occur again;
2. each block sends the distinct contexts of repeated anchors (the bytes before and after that windows can cover), with
   their first place in the block; later places in the block are repeats already;
3. each bucket sorts the suffixes at its anchors, and the reversed bytes before them: multikey quicksort to SHALLOW
   words, then blind tries order the groups that still share a prefix. Two anchors share the window that starts r bytes
   before them if their suffixes share WINDOW - r bytes and their reversed heads r bytes, so the classes of both sorts
   give the windows' groups; all but the first of a group are repeats;
4. each block marks what its windows cover.

Anchors with over HOT contexts (a passage that a third of all documents hold) don't go to one bucket as contexts: their
windows go out one by one under fingerprints, spread over all buckets and reduced to the first place by block. A
fingerprint is two hashes that share no intermediate value, of 63 random bits at least each; equal ones are taken as equal
windows, so among 10^13 such windows the chance of any wrong pair is under 10^-11.
Texts are dealt out once; the three steps that read them reuse that exchange.

Defined cases: null is the empty text; texts shorter than a window keep all bytes; rows that share an id are ordered
by text; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table

WINDOW = 100
GRAM = 32
HEAD = WINDOW - GRAM
SHALLOW = 4
HOT = 512
BLOCK_BYTES = 2 << 20
_CHUNK = 1 << 19
_NO_ID = 2**63 - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: multipliers of the second, independent half of a window's fingerprint
_SECOND = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def gram_hashes(data: np.ndarray, by: tuple[np.uint64, np.uint64, np.uint64] = (_A, _B, _C)) -> np.ndarray:
    """A non-zero hash of the GRAM bytes from each position on."""
    a, b, c = by
    v = data.astype(np.uint64)
    for shift in (1, 2, 4):
        v = v[:-shift] | (v[shift:] << np.uint64(8 * shift))
    n = len(data) - GRAM + 1
    h = v[:n] * a
    for at in range(8, GRAM, 8):
        h = (h ^ (h >> np.uint64(31))) * c + v[at : at + n] * b
    h = (h ^ (h >> np.uint64(29))) * a
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


def window_hashes(data: np.ndarray, at: np.ndarray, by: tuple[np.uint64, np.uint64, np.uint64]) -> np.ndarray:
    """A hash of the WINDOW bytes from each of `at` on; hashes by different multipliers share nothing."""
    grams, out = gram_hashes(data, by), np.zeros(len(at), np.uint64)
    for shift in (0, GRAM, 2 * GRAM, HEAD):
        out = (out ^ (out >> np.uint64(31))) * by[0] + grams[at + shift]
    return out


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over `width` values from each position on."""
    done = 1
    while 2 * done <= width:
        values, done = op(values[:-done], values[done:]), 2 * done
    rest = width - done
    return op(values[: len(values) - rest], values[rest:]) if rest else values


class Block:
    """The documents of a block, one after the other, and their anchors."""

    def __init__(self, rows: pa.Table) -> None:
        order = sorted(range(rows.num_rows), key=lambda n: (rows["id"][n].as_py(), rows["text"][n].as_py()))
        self.rows = rows.take(order) if rows.num_rows else rows
        self.ids = self.rows["id"].to_numpy() if rows.num_rows else np.empty(0, np.int64)
        texts = [memoryview(x.as_buffer()) for x in self.rows["text"]]
        sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        same = np.r_[False, self.ids[1:] == self.ids[:-1]] if len(self.ids) else np.empty(0, bool)
        at = np.arange(len(self.ids))
        self.copies = at - np.maximum.accumulate(np.where(same, 0, at)) if len(at) else at

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all anchors."""
        found, hashes = [], []
        ends = np.repeat(self.starts[1:], np.diff(self.starts)) if len(self.data) else np.empty(0, np.int64)
        for begin in range(0, len(self.data), _CHUNK):
            part = self.data[begin : begin + _CHUNK + WINDOW - 1]
            if len(part) < WINDOW:
                break
            h = gram_hashes(part)
            least = _sliding(h, HEAD + 1, np.minimum)
            inside = np.arange(begin, begin + len(least)) + WINDOW <= ends[begin : begin + len(least)]
            least[~inside] = 0
            most = _sliding(np.concatenate([np.zeros(HEAD, np.uint64), least, np.zeros(HEAD, np.uint64)]), HEAD + 1, np.maximum)
            at = np.flatnonzero(most[: len(h)] == h)
            found.append(at + begin)
            hashes.append(h[at])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at, first = np.unique(np.concatenate(found), return_index=True)
        return at, np.concatenate(hashes)[first]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def places(self, at: np.ndarray) -> np.ndarray:
        """(id, copy and position) of each position; their order is the order of starts."""
        doc = self.doc_of(at)
        return np.stack([self.ids[doc], (self.copies[doc] << 40) | (at - self.starts[doc])], axis=1)

    def positions(self, places: np.ndarray) -> np.ndarray:
        base = np.searchsorted(self.ids, places[:, 0], side="left") + (places[:, 1] >> 40)
        return self.starts[base] + (places[:, 1] & (1 << 40) - 1)


def _dealt(block: int, buckets: np.ndarray, many: int, pack: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One row for each bucket that gets something."""
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    parts = [order[a:b] for a, b in zip(edges, np.r_[edges[1:], len(ordered)])]
    return pa.table({"bucket": pa.array(ordered[edges], pa.int32()), "block": pa.array(np.full(len(edges), block), pa.int32()), "payload": pa.array([pack(p) for p in parts], pa.binary())})


def _joined(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths, readable by _parted."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _parted(payload: bytes) -> list[bytes]:
    many = int(np.frombuffer(payload, np.int64, 1)[0])
    sizes = np.frombuffer(payload, np.int64, many, 8)
    at, out = 8 * (many + 1), []
    for size in sizes:
        out.append(payload[at : at + size])
        at += int(size)
    return out


def _ask(many: int, hot: int) -> Callable[[pa.Table], pa.Table]:
    def ask(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        at, h = block.anchors()
        # places that differ in the bytes around the anchor count as contexts; a guess that only steers step 2
        size = len(block.data)
        around = np.zeros(len(at), np.uint64)
        for shift in (-HEAD // 2 - 2, WINDOW - GRAM // 2):
            around = around * _A + block.data[np.clip(at + shift, 0, max(size - 1, 0))] if size else around
        pairs = np.unique(np.stack([h, around], axis=1), axis=0)[:, 0] if len(h) else h
        (distinct, contexts), occurrences = np.unique(pairs, return_counts=True), np.unique(h, return_counts=True)[1]
        repeated = (occurrences > 1).astype(np.uint8)

        def pack(rows: np.ndarray) -> bytes:
            return _joined(distinct[rows], np.minimum(contexts[rows], hot + 1).astype(np.uint16), repeated[rows])

        return _dealt(rows["block"][0].as_py(), (distinct % np.uint64(many)).astype(np.int64), many, pack)

    return ask


def _answer(hot: int) -> Callable[[pa.Table], pa.Table]:
    def answer(asks: pa.Table) -> pa.Table:
        parts = [_parted(p.as_py()) for p in asks["payload"]]
        hashes = [np.frombuffer(p[0], np.uint64) for p in parts]
        every = np.concatenate(hashes)
        known, inverse = np.unique(every, return_inverse=True)
        contexts = np.bincount(inverse, weights=np.concatenate([np.frombuffer(p[1], np.uint16) for p in parts]))
        repeats = np.bincount(inverse) + np.bincount(inverse, weights=np.concatenate([np.frombuffer(p[2], np.uint8) for p in parts]))
        kind = np.where(contexts > hot, 2, np.where(repeats > 1, 1, 0)).astype(np.uint8)
        out, at = [], 0
        for h in hashes:
            mine = kind[inverse[at : at + len(h)]]
            at += len(h)
            out.append(_joined(h[mine > 0], mine[mine > 0]))
        return pa.table({"block": asks["block"], "payload": pa.array(out, pa.binary())})

    return answer


def _windows(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` bytes from each position on, zeros beyond the data."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[at]


def _first_by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of place: indices of the first of each key, and of the others."""
    raw = np.ascontiguousarray(keys).view([("", np.void, keys.shape[1] * keys.itemsize)]).ravel() if keys.ndim == 2 else keys
    _, first = np.unique(raw, return_index=True)
    mask = np.zeros(len(keys), bool)
    mask[first] = True
    return np.flatnonzero(mask), np.flatnonzero(~mask)


def _contexts(many: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        if not rows.num_rows or not answers.num_rows:
            return empty
        number, block = rows["block"][0].as_py(), Block(rows)
        parts = [_parted(p.as_py()) for p in answers["payload"]]
        wanted, kinds = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts]), np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts])
        if not len(wanted):
            return empty
        order = np.argsort(wanted)
        wanted, kinds = wanted[order], kinds[order]
        at, h = block.anchors()
        slot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        kind = np.where(wanted[slot] == h, kinds[slot], 0)
        doc = block.doc_of(at)
        before = np.minimum(at - block.starts[doc], HEAD).astype(np.uint8)
        after = np.minimum(block.starts[doc + 1] - at, WINDOW).astype(np.uint8)
        tables = []
        cold = np.flatnonzero(kind == 1)
        if len(cold):
            a, b, c = at[cold], before[cold], after[cold]
            padded = np.concatenate([np.zeros(HEAD, np.uint8), block.data])
            rows_ = np.concatenate([_windows(padded, a, HEAD)[:, ::-1], _windows(block.data, a, WINDOW)], axis=1)
            rows_[:, :HEAD][np.arange(HEAD) >= b[:, None]] = 0
            rows_[:, HEAD:][np.arange(WINDOW) >= c[:, None]] = 0
            rows_ = np.concatenate([rows_, b[:, None], c[:, None]], axis=1)
            first, later = _first_by(rows_)
            places, buckets = block.places(a), (h[cold] % np.uint64(many)).astype(np.int64)
            is_first = np.zeros(len(cold), bool)
            is_first[first] = True

            def pack(part: np.ndarray) -> bytes:
                f, n = part[is_first[part]], part[~is_first[part]]
                return _joined(rows_[f], places[f], places[n], np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))

            tables.append(_dealt(number, buckets, many, pack))
        hot = np.flatnonzero(kind == 2)
        if len(hot):
            low, high = at[hot] - before[hot], np.minimum(at[hot], at[hot] + after[hot].astype(np.int64) - WINDOW)
            mark = np.zeros(len(block.data) + 1, np.int64)
            fits = low <= high
            np.add.at(mark, low[fits], 1)
            np.add.at(mark, high[fits] + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if len(starts):
                prints = np.zeros((len(starts), 2), np.uint64)
                for begin in range(0, len(block.data), _CHUNK):
                    a, b = np.searchsorted(starts, (begin, begin + _CHUNK))
                    if a == b:
                        continue
                    part, at_ = block.data[begin : begin + _CHUNK + WINDOW], starts[a:b] - begin
                    for half, by in enumerate(((_A, _B, _C), _SECOND)):
                        prints[a:b, half] = window_hashes(part, at_, by)
                first, later = _first_by(prints)
                places, buckets = block.places(starts), (prints[:, 0] % np.uint64(many)).astype(np.int64)
                is_first = np.zeros(len(starts), bool)
                is_first[first] = True

                def pack_hot(part: np.ndarray) -> bytes:
                    f, n = part[is_first[part]], part[~is_first[part]]
                    none = np.empty(0, np.uint8)
                    return _joined(none, none, none, prints[f], places[f], places[n])

                tables.append(_dealt(number, buckets, many, pack_hot))
        return pa.concat_tables(tables) if tables else empty

    return contexts


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their first `depth` words, and the group of each place in the order; all segments at once."""
    n = len(words)
    order, group, level = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = np.arange(n)  # places in segments that aren't done
    while len(todo):
        g, edges = group[todo], np.flatnonzero(np.r_[True, group[todo][1:] != group[todo][:-1]])
        sizes = np.diff(np.r_[edges, len(todo)])
        keys = words[order[todo], level[todo]]
        pivot = np.repeat(keys[edges + sizes // 2], sizes)
        side = (keys > pivot).astype(np.int64) * 2 + (keys == pivot)
        moved = np.argsort(g * 3 + side, kind="stable")
        order[todo], side = order[todo][moved], side[moved]
        level[todo] = level[todo][moved] + (side == 1)
        # groups are numbered by their first place
        new = np.r_[True, (g[1:] != g[:-1]) | (side[1:] != side[:-1])]
        first = np.flatnonzero(new)
        group[todo] = np.repeat(todo[first], np.diff(np.r_[first, len(todo)]))
        many = np.repeat(np.diff(np.r_[first, len(todo)]), np.diff(np.r_[first, len(todo)]))
        todo = todo[(many > 1) & (level[todo] < depth)]
    return order, group


class BlindTrie:
    """Strings of one length by their branching bytes only; equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, text: bytes, name: int) -> None:
        leaf = [len(text), None, text, [name]]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while node[1] is not None:  # blind descent: skipped bytes are compared at the leaf only
            child = node[1].get(text[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[2]
        if other == text:
            node[3].append(name)
            return
        size = len(text)
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        shared = size - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[1] is not None and node[0] < shared:
            above, node = node, node[1][text[node[0]]]
        if node[1] is not None and node[0] == shared:
            node[1][text[shared]] = leaf
            return
        branch = [shared, {other[shared]: node, text[shared]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def sorted(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[1] is None:
                out += node[3]
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows of one width, and each one's common prefix with the one before (0 for the first)."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, group = multikey_quicksort(words, min(shallow, words.shape[1]))
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[edges[1:], n]
    for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist()):
        trie = BlindTrie()
        for name in order[a:b].tolist():
            trie.add(rows[name].tobytes(), name)
        order[a:b] = trie.sorted()
    prefix = np.zeros(n, np.int64)
    if n > 1:
        for begin in range(1, n, 1 << 14):
            x, y = rows[order[begin - 1 : begin - 1 + (1 << 14)]], rows[order[begin : begin + (1 << 14)]]
            x = x[: len(y)]
            differ = x != y
            prefix[begin : begin + len(y)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, prefix


def repeated_windows(contexts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each context a row of HEAD + 1 flags: is the window that starts r bytes before its anchor not the first?"""
    n = len(contexts)
    flags = np.zeros((n, HEAD + 1), bool)
    before, after = contexts[:, -2].astype(np.int64), contexts[:, -1].astype(np.int64)
    order, suffix = deep_shallow(contexts[:, HEAD:-2])
    anchor = np.empty(n, np.int64)
    anchor[order] = np.cumsum(suffix < GRAM)
    together = np.bincount(anchor)[anchor] > 1
    kept = np.flatnonzero(together)
    if not len(kept):
        return flags
    keep_order = together[order]
    # prefixes between the kept ones are unchanged: whole groups of an anchor are kept or dropped
    order, suffix = order[keep_order], suffix[keep_order]
    local = np.empty(n, np.int64)
    local[kept] = np.arange(len(kept))
    order = local[order]
    before, after = before[kept], after[kept]
    head_order, head = deep_shallow(contexts[kept][:, :HEAD])
    rank = np.empty(len(kept), np.int64)
    rank[np.lexsort((places[kept, 1], places[kept, 0]))] = np.arange(len(kept))
    right, left = np.empty(len(kept), np.int64), np.empty(len(kept), np.int64)
    for r in range(HEAD + 1):
        right[order] = np.cumsum(suffix < WINDOW - r)
        left[head_order] = np.cumsum(head < r)
        valid = np.flatnonzero((before >= r) & (after >= WINDOW - r))
        if len(valid) < 2:
            continue
        key = right[valid] * (len(kept) + 1) + left[valid]
        by = np.lexsort((rank[valid], key))
        again = np.r_[False, key[by][1:] == key[by][:-1]]
        flags[kept[valid[by[again]]], r] = True
    return flags


def _sorted(sent: pa.Table) -> pa.Table:
    parts = [_parted(p.as_py()) for p in sent["payload"]]
    width = HEAD + WINDOW + 2
    rows = [np.frombuffer(p[0], np.uint8).reshape(-1, width) for p in parts]
    places = [np.frombuffer(p[1], np.int64).reshape(-1, 2) for p in parts]
    prints = [np.frombuffer(p[3], np.uint64).reshape(-1, 2) for p in parts]
    starts = [np.frombuffer(p[4], np.int64).reshape(-1, 2) for p in parts]
    flags = repeated_windows(np.concatenate(rows), np.concatenate(places))
    packed = np.packbits(flags, axis=1)
    all_prints, all_starts = np.concatenate(prints), np.concatenate(starts)
    by = np.lexsort((all_starts[:, 1], all_starts[:, 0], all_prints[:, 1], all_prints[:, 0]))
    again = np.zeros(len(by), bool)
    again[by[1:]] = (all_prints[by[1:]] == all_prints[by[:-1]]).all(1)
    out, at, hot_at = [], 0, 0
    for p, x, s in zip(parts, places, starts):
        mine, hot = packed[at : at + len(x)], again[hot_at : hot_at + len(s)]
        at, hot_at = at + len(x), hot_at + len(s)
        some = mine.any(1)
        out.append(_joined(x[some], mine[some], np.frombuffer(p[2], np.int64), np.concatenate([s[hot].ravel(), np.frombuffer(p[5], np.int64)])))
    return pa.table({"block": sent["block"], "payload": pa.array(out, pa.binary())})


def _marked(rows: pa.Table, marks: pa.Table) -> pa.Table:
    block = Block(rows)
    size = len(block.data)
    covered = np.zeros(size + 1, np.int32)

    def mark(starts: np.ndarray, doc_at: np.ndarray) -> None:
        doc = block.doc_of(doc_at)
        fits = (starts >= block.starts[doc]) & (starts + WINDOW <= block.starts[doc + 1])
        repeat[starts[fits]] = True

    repeat = np.zeros(size + 1, bool)
    for payload in marks["payload"]:
        some, flags, full, single = _parted(payload.as_py())
        at = block.positions(np.frombuffer(some, np.int64).reshape(-1, 2))
        bits = np.unpackbits(np.frombuffer(flags, np.uint8).reshape(len(at), -1), axis=1)[:, : HEAD + 1] if len(at) else np.zeros((0, HEAD + 1), np.uint8)
        n, r = np.nonzero(bits)
        mark(at[n] - r, at[n])
        at = block.positions(np.frombuffer(full, np.int64).reshape(-1, 2))
        for begin in range(0, len(at), 1 << 14):
            part = at[begin : begin + (1 << 14)]
            mark((part[:, None] - np.arange(HEAD + 1)).ravel(), np.repeat(part, HEAD + 1))
        repeat[block.positions(np.frombuffer(single, np.int64).reshape(-1, 2))] = True
    starts = np.flatnonzero(repeat)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    gone = np.cumsum(covered[:-1], dtype=np.int32) > 0
    out = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for n, id_ in enumerate(block.ids.tolist()):
        a, b = int(block.starts[n]), int(block.starts[n + 1])
        lost = gone[a:b]
        out["id"].append(id_)
        out["n_bytes"].append(b - a)
        out["n_removed"].append(int(lost.sum()))
        out["n_spans"].append(int((lost[1:] & ~lost[:-1]).sum() + lost[:1].sum()))
        out["kept_sha256"].append(hashlib.sha256(block.data[a:b][~lost].tobytes()).hexdigest())
    types = {"kept_sha256": pa.string()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-size // BLOCK_BYTES) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))
    blocks, sent = rows.groupBy("block"), "bucket int, block int, payload binary"
    answers = blocks.applyInArrow(_ask(many, hot), sent).groupBy("bucket").applyInArrow(_answer(hot), "block int, payload binary")
    contexts = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_contexts(many), sent)
    marks = contexts.groupBy("bucket").applyInArrow(_sorted, "block int, payload binary")
    out = rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_marked, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
