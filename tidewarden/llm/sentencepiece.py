"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

The model file is a SentencePiece model (its path is a parameter; nothing is trained). A unigram model's scores
are log probabilities already. A BPE model's scores are minus the merge rank r; they become log probabilities by
Zipf's law, p proportional to 1 / (r + 2), normalised over the pieces.

Texts are encoded whole: a space becomes the marker U+2581, one marker is put before the text, and the path of highest
total score is taken. A character that no piece covers is an unknown node of the lowest score less 10 and is
written as its UTF-8 bytes. Scores are added in fixed point, so sums are exact; of paths of equal score, the one whose last
piece begins first is taken, at each place. No piece holds a marker after another character, so the best path of a text is
the best paths of its segments (markers, then other characters) one after another; equal segments are solved once in a batch
and kept in a bounded cache, found by hash and compared byte by byte. Segments of like length are solved together, position by
position, in numpy; in a very long one, matches are found at all places together and the path is then folded over them.

Decoding joins pieces and bytes, turns markers into spaces and drops the first space.

Defined cases: null and empty texts have no tokens and decode to empty text; repeated rows are encoded each;
an empty table gives an empty result; other columns are ignored by `encode_documents`. A marker U+2581 in a text
decodes to a space, as in the library, so `round_trip` is false there."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments, and bytes of segments, that a worker remembers; when there are more, it starts anew.
CACHE_SEGMENTS = 300_000
CACHE_BYTES = 4 << 20
#: Bytes of the segments, padded to the longest, that are solved side by side; bytes from which a segment is solved alone.
TOGETHER = 1 << 18
ALONE = 1 << 11

_MARK = "▁".encode()
#: Fixed-point one, and the unknown node's distance from the lowest score.
_ONE = 1 << 32
_UNKNOWN_PENALTY = 10 * _ONE
_NONE = np.iinfo(np.int64).min // 2


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a trie over sorted distinct keys; value is the key's number or -1."""
    base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
    check[0] = 0
    free, start = 260, 260  # where single and several children are tried first; over any byte + 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[node] = lo
            lo += 1
        if lo == hi:
            base[node] = 0
            continue
        spans, i = [], lo
        while i < hi:
            j = i
            while j < hi and keys[j][depth] == keys[i][depth]:
                j += 1
            spans.append((keys[i][depth] + 1, i, j))
            i = j
        at, tries = max(1, (free if len(spans) == 1 else start) - spans[0][0]), 0
        while True:
            if at + 260 > len(check):
                grow = len(check)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
            if all(check[at + b] < 0 for b, _, _ in spans):
                break
            at, tries = at + 1, tries + 1
        if tries > 64:
            start = at + spans[0][0]
        base[node] = at
        for b, i, j in spans:
            check[at + b] = node
            todo.append((at + b, i, j, depth + 1))
        while check[free] >= 0:
            free += 1
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


class Model:
    """Pieces, scores and trie of a model file, with a cache of solved segments."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        kind = pb.ModelProto.SentencePiece.Type
        self.pieces = [p.piece.encode() for p in m.pieces]
        normal = [i for i, p in enumerate(m.pieces) if p.type == kind.NORMAL]
        raw = np.array([m.pieces[i].score for i in normal])
        logs = raw if m.trainer_spec.model_type == 1 else -np.log(2 - raw)
        if m.trainer_spec.model_type != 1:
            logs = logs - np.log(np.exp(logs).sum())
        self.score = np.zeros(len(self.pieces), np.int64)
        self.score[normal] = np.rint(logs * _ONE).astype(np.int64)
        self.unknown = int(self.score[normal].min()) - _UNKNOWN_PENALTY
        self.bytes = np.zeros(256, np.int32)
        for i, p in enumerate(m.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        ids = sorted(normal, key=lambda i: self.pieces[i])
        self.base, self.check, value = double_array([self.pieces[i] for i in ids])
        self.value = np.where(value >= 0, np.array(ids, np.int32)[value], -1).astype(np.int32)
        self.deepest = max(len(self.pieces[i]) for i in ids)
        inner = {b for i in ids if len(self.pieces[i]) > 1 for b in self.pieces[i]}
        self.alone = np.array([b < 128 and b not in inner and b != 32 for b in range(256)])
        # decoded bytes of each id, and where they begin
        shown = [bytes([int(
            p.piece[3:5], 16,
        )]) if p.type == kind.BYTE else p.piece.encode().replace(_MARK, b" ") if p.type == kind.NORMAL else b"" for p in m.pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate(([0], np.cumsum([len(x) for x in shown])))
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.tokens = np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.raw = np.zeros(0, np.uint8)
        self.raw_at, self.raw_size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def solve(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of segments in which markers are written out, one after another, and each segment's number of ids."""
        size = np.array([len(x) for x in segments])
        order = np.argsort(size, kind="stable")
        ids, counts, i = [], [], 0
        while i < len(order):
            j = min(i + 4096, len(order))
            while j > i + 1 and (j - i) * size[order[j - 1]] > TOGETHER:
                j = i + (j - i) // 2
            got = self._solve_alone(segments[order[i]]) if j == i + 1 and size[order[i]] > ALONE else self._solve_together([segments[k] for k in order[i:j]])
            ids.append(got[0])
            counts.append(got[1])
            i = j
        flat, count = np.concatenate(ids), np.concatenate(counts)
        first = np.cumsum(count) - count
        back = np.argsort(order)
        count, first = count[back], first[back]
        new = np.cumsum(count) - count
        return flat[np.arange(len(flat)) + np.repeat(first - new, count)], count

    def _solve_alone(self, segment: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long segment: all matches by numpy, then one fold over them."""
        n = len(segment)
        text = np.frombuffer(segment + b"\0" * (self.deepest + 1), np.uint8)
        lead = np.flatnonzero((text[:n] & 0xC0) != 0x80)
        live, state, found = lead, np.zeros(len(lead), np.int32), []
        for d in range(self.deepest):
            go = self.base[state] + text[live + d] + 1
            ok = (self.base[state] > 0) & (live + d < n)
            ok &= self.check[np.where(ok, go, 0)] == state
            live, state = live[ok], go[ok]
            if not len(live):
                break
            hit = self.value[state] >= 0
            found.append((live[hit], live[hit] + d + 1, self.value[state[hit]]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((end, start))
        start, end, piece = start[order], end[order], piece[order]
        edge = np.searchsorted(start, np.append(lead, n)).tolist()
        stop, names, gain = end.tolist(), piece.tolist(), self.score[piece].tolist()
        best, came, by = [_NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for k, (i, after) in enumerate(zip(lead.tolist(), [*lead[1:].tolist(), n], strict=True)):
            here, single = best[i], False
            if here == _NONE:
                continue
            for m in range(edge[k], edge[k + 1]):
                to = stop[m]
                single |= to == after
                if here + gain[m] > best[to]:
                    best[to], came[to], by[to] = here + gain[m], i, names[m]
            if not single and here + self.unknown > best[after]:
                best[after], came[after], by[after] = here + self.unknown, i, -1
        out, at = [], n
        while at:
            i = came[at]
            out.append([by[at]] if by[at] >= 0 else [int(self.bytes[b]) for b in segment[i:at]])
            at = i
        ids = np.array([x for part in reversed(out) for x in part], np.int32)
        return ids, np.array([len(ids)])

    def _solve_together(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(segments), np.array([len(s) for s in segments])
        longest = int(size.max(initial=0))
        text = np.frombuffer(b"".join(s.ljust(longest + 4, b"\0") for s in segments), np.uint8).reshape(n, longest + 4)
        best = np.full((n, longest + 1), _NONE, np.int64)
        best[:, 0] = 0
        piece = np.full((n, longest + 1), -2, np.int32)  # -1: unknown
        came = np.zeros((n, longest + 1), np.int32)
        for i in range(longest):
            rows = np.flatnonzero((best[:, i] > _NONE) & (size > i))
            if not len(rows):
                continue
            lead = text[rows, i]
            chars = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            chars = np.minimum(chars, size[rows] - i)
            single = np.zeros(n, bool)
            wanted = np.zeros(n, np.int64)
            wanted[rows] = chars
            live, state, here = rows, np.zeros(len(rows), np.int32), best[rows, i]
            for d in range(min(self.deepest, longest - i)):
                go = self.base[state] + text[live, i + d] + 1
                ok = (self.base[state] > 0) & (i + d < size[live])
                ok &= self.check[np.where(ok, go, 0)] == state
                ok &= go > 0
                live, state, here = live[ok], go[ok], here[ok]
                if not len(live):
                    break
                ends = self.value[state]
                hit = ends >= 0
                at, ids = live[hit], ends[hit]
                single[at[wanted[at] == d + 1]] = True
                total = self.score[ids] + here[hit]
                better = total > best[at, i + d + 1]
                at, to = at[better], i + d + 1
                best[at, to], piece[at, to], came[at, to] = total[better], ids[better], i
            lone = rows[~single[rows]]
            if len(lone):
                to = i + wanted[lone]
                total = self.unknown + best[lone, i]
                better = total > best[lone, to]
                best[lone[better], to[better]], piece[lone[better], to[better]], came[lone[better], to[better]] = total[better], -1, i
        at, alive, steps = size.copy(), np.arange(n), []
        while len(alive):
            ids, frm = piece[alive, at[alive]], came[alive, at[alive]]
            steps.append((alive, ids, frm, at[alive]))
            at[alive] = frm
            alive = alive[frm > 0]
        owner, ids, frm, to = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((frm, owner))
        owner, ids, frm, to = owner[order], ids[order], frm[order], to[order]
        if (ids == -1).any():
            width = np.where(ids == -1, to - frm, 1)
            back = np.repeat(np.arange(len(ids)), width)
            inner = np.arange(len(back)) - np.repeat(np.cumsum(width) - width, width)
            raw = ids[back] == -1
            spread = ids[back].copy()
            spread[raw] = self.bytes[text[owner[back[raw]], frm[back[raw]] + inner[raw]]]
            ids, owner = spread, owner[back]
        return ids, np.bincount(owner, minlength=n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts given as bytes and offsets, with offsets of the ids."""
        size = np.diff(off)
        has = size > 0
        # a space before each text that isn't empty
        new = np.concatenate(([0], np.cumsum(size + has)))
        text = np.full(new[-1], 32, np.uint8)
        body = np.ones(new[-1], bool)
        body[new[:-1][has]] = False
        text[body] = data
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        cut = np.zeros(len(text), bool)
        cut[new[:-1][has]] = True
        cut[1:] |= (text[1:] == 32) & (text[:-1] != 32)
        lone = self.alone[text]
        cut |= lone
        cut[1:] |= lone[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text))
        keys, size = c.span_hashes(text, starts, ends), ends - starts
        raw = text.tobytes()
        fresh, at = self._missing(keys)
        if len(self.known) and (len(self.known) + len(fresh) > CACHE_SEGMENTS or len(self.raw) + size[at].sum() > CACHE_BYTES):
            self._forget()
            fresh, at = self._missing(keys)
        solve = lambda places: self.solve([raw[starts[i] : ends[i]].replace(b" ", _MARK) for i in places])
        if len(fresh):
            self._learn(fresh, solve(at), text, starts[at], size[at])
        place = np.searchsorted(self.known, keys)
        counts, first, tokens = self.count[place].astype(np.int64), self.first[place].astype(np.int64), self.tokens
        odd = np.flatnonzero(~c.equal_spans(text, starts, self.raw, self.raw_at[place], size, self.raw_size[place]))
        if len(odd):  # other bytes with the hash of a known segment
            more, counts[odd] = solve(odd)
            first[odd] = len(tokens) + np.cumsum(counts[odd]) - counts[odd]
            tokens = np.concatenate((tokens, more))
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = tokens[np.arange(total[-1]) + np.repeat(first - total[:-1], counts)]
        return ids, total[np.searchsorted(starts, new)]

    def _missing(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that no known segment has, each once, and where they are."""
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            where = np.flatnonzero(self.known[place] != keys)
        else:
            where = np.arange(len(keys))
        order = where[np.argsort(keys[where], kind="stable")]
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        return s[new], order[new]

    def _learn(self, keys: np.ndarray, solved: tuple[np.ndarray, np.ndarray], text: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        ids, count = solved
        at = np.searchsorted(self.known, keys)
        put = lambda old, new: np.insert(old, at, new).astype(old.dtype)
        self.known, self.count, self.raw_size = put(self.known, keys), put(self.count, count), put(self.raw_size, size)
        self.first = put(self.first, len(self.tokens) + np.cumsum(count) - count)
        new = np.cumsum(size) - size
        self.raw_at = put(self.raw_at, len(self.raw) + new)
        self.raw = np.concatenate((self.raw, text[np.arange(size.sum()) + np.repeat(starts - new, size)]))
        self.tokens = np.concatenate((self.tokens, ids)).astype(np.int32)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of token ids, as bytes and offsets; each text's first space is dropped."""
        width = np.diff(self.shown_at)[ids]
        total = np.concatenate(([0], np.cumsum(width)))
        text = self.shown[np.arange(total[-1]) + np.repeat(self.shown_at[ids] - total[:-1], width)]
        new = total[off]
        heads = new[:-1][np.diff(new) > 0]
        heads = heads[text[heads] == 32]
        keep = np.ones(len(text), bool)
        keep[heads] = False
        gone = np.concatenate(([0], np.cumsum(~keep)))
        return text[keep], new - gone[new]


@lru_cache(maxsize=2)
def _model(proto: bytes) -> Model:
    return Model(proto)


def load(path: str = MODEL_PATH) -> Model:
    with open(path, "rb") as f:
        return _model(f.read())


def encode_documents(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, round_trip (whether the decoded ids are the text again)."""
    spark = docs.sparkSession
    c.small_batches(spark)
    with open(path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto.value)
        for batch in batches:
            data, off = c.utf8(batch.column(1))
            for i, j in c.chunks(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, ends = model.encode(part, at)
                back, back_at = model.decode(ids, ends)
                same = np.diff(back_at) == np.diff(at)
                if not (same.all() and np.array_equal(back, part)):
                    same &= np.array(
                        [np.array_equal(back[a:b], part[x:y]) for a, b, x, y in zip(back_at[:-1], back_at[1:], at[:-1], at[1:], strict=True)], bool,
                    )
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), lists, pa.array(np.diff(ends)), pa.array(same)],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
