"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text holds an edge for every vocabulary piece at every position; its forward
Viterbi scores are computed for all distinct units of a batch at once (trie walk and dynamic
programme in numpy).  Pieces never cross a unit (a run of spaces with the word after it, or a
line feed), so the best segmentation of a text is the concatenation of those of its units.

N-best: forward scores are exact heuristics for a backward A* search, which therefore pops
complete paths in order of score.  A path that leaves the best one in a unit loses at least
that unit's smallest deviation, so the N - 1 units with the smallest deviations of a text
suffice for its N best segmentations; A* runs on them and their lists are combined.

Scores: a byte-pair model stores ranks, not probabilities; they become the log of a
normalised Zipf law over the ranks.  A unigram model's scores are used as they are.  A
character without a piece of its own falls back to its bytes.

Defined results: a null text gives null ids, an empty one no ids.  Decoding an encoding gives
the text back byte for byte, the space that encoding puts in front apart; U+2581 in a text is
encoded by its bytes.  Of equal scores the longest last piece wins.  Repeated rows get equal
ids.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, fresh, segment_sum, sliced, text_array

NBEST = 3
SLICE = 1 << 20
#: Distinct units, and their bytes, past which a worker forgets the segmentations that it has kept.
KEPT_UNITS, KEPT_BYTES = 1 << 18, 16 << 20
_BYTE_COST = 12.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as bytes (the marker of a space is a space), their scores, and the ids of the byte pieces."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.path = path or default_model()
        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = model.get_piece_size()
        raw = np.array([model.get_score(i) for i in range(n)])
        self.pieces: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int32)
        self.normal = np.zeros(n, bool)
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.pieces.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.pieces.append(b"")
            else:
                if "▁" in text.lstrip("▁") or "\n" in text:
                    raise ValueError(f"piece {i} crosses a word boundary")
                self.pieces.append(text.replace("▁", " ").encode())
                self.normal[i] = True
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        ranked = raw[self.normal]
        if np.all(ranked <= -1) and np.allclose(ranked[ranked > -1e8], np.round(ranked[ranked > -1e8])):
            rank = np.where(raw > -1e8, -raw, -raw[self.normal & (raw > -1e8)].min())
            weight = 1 / (np.maximum(rank, 0) + 2.7)
            raw = np.log(weight / weight[self.normal].sum())
        self.scores = np.where(self.normal, raw, raw[self.normal].min() - _BYTE_COST)


class Trie:
    """Transitions of the inner nodes as one dense table; row 0 leads nowhere."""

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, p in enumerate(vocabulary.pieces):
            if not vocabulary.normal[i]:
                continue
            node = 0
            for b in p:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    piece.append(-1)
                node = nxt
            piece[node] = i
        inner = [k for k, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.full((len(inner) + 1, 256), -1, np.int32)
        for r, k in enumerate(inner, 1):
            for b, child in children[k].items():
                self.next[r, b] = child
        self.piece = np.array(piece, np.int32)


class Lattices:
    """Edges and forward scores of many units at once; nodes are byte positions, one more than bytes a unit."""

    def __init__(self, units: pa.Array, vocabulary: Vocabulary, trie: Trie):
        raw, offs = buffers(units)
        self.count = len(units)
        lengths = np.diff(offs)
        unit_of = np.repeat(np.arange(self.count), lengths)
        self.first_node = offs[:-1] + np.arange(self.count)
        self.last_node = offs[1:] + np.arange(self.count)
        end_of = offs[1:][unit_of]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        char_len = np.diff(np.append(lead, len(raw)))
        own = np.zeros(len(raw), bool)
        starts, ids, widths = [], [], []
        at, rows, sizes, limit, step = lead, np.full(len(lead), trie.row[0]), char_len, end_of[lead], 0
        while len(at):
            node = trie.next[rows, raw[at + step]]
            hit = node >= 0
            at, node, sizes, limit = at[hit], node[hit], sizes[hit], limit[hit]
            piece = trie.piece[node]
            step += 1
            done = piece >= 0
            starts.append(at[done])
            ids.append(piece[done])
            widths.append(step)
            own[at[done & (sizes == step)]] = True
            rows = trie.row[node]
            more = (rows > 0) & (at + step < limit)
            at, rows, sizes, limit = at[more], rows[more], sizes[more], limit[more]
        loose = np.flatnonzero(np.repeat(~own[lead], char_len))
        starts, ids, widths = [loose, *starts], [vocabulary.byte_ids[raw[loose]], *ids], [1, *widths]
        # Edges lie in the order of their widths; edges of one width have different ends.
        blocks = np.cumsum([0, *(len(x) for x in starts)])
        start, self.ids = np.concatenate(starts), np.concatenate(ids)
        end = start + np.repeat(widths, np.diff(blocks))
        self.owner = unit_of[start]
        self.start, self.end = start + self.owner, end + self.owner
        self.score = vocabulary.scores[self.ids]
        self.best = np.full(len(raw) + self.count, -np.inf)
        self.best[self.first_node] = 0
        self.back = np.full(len(self.best), -1, np.int64)
        rel = end - offs[self.owner]
        longest = int(rel.max()) if len(rel) else 0
        by_end = np.argsort(rel.astype(np.uint16) if longest < 1 << 16 else rel, kind="stable")
        cuts = np.cumsum(np.bincount(rel, minlength=longest + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            edges = by_end[lo:hi]
            value, target = self.best[self.start[edges]] + self.score[edges], self.end[edges]
            if hi - lo > 200:  # width by width
                at = np.searchsorted(edges, blocks).tolist()
                for a, b in zip(at[:-1], at[1:]):
                    if b > a:
                        better = np.flatnonzero(value[a:b] >= self.best[target[a:b]]) + a
                        self.best[target[better]] = value[better]
                        self.back[target[better]] = edges[better]
            elif hi > lo:  # the last of equal ends is the best, and of equal values the widest
                order = np.lexsort((value, target))
                last = order[np.append(target[order][1:] != target[order][:-1], True)]
                self.best[target[last]] = value[last]
                self.back[target[last]] = edges[last]

    def best_paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all units in order, each unit's first, and the nodes that the best paths visit."""
        visited = np.zeros(len(self.best), bool)
        units, node = np.arange(self.count), self.last_node.copy()
        visited[node] = True
        found_u, found_p = [], []
        todo = node > self.first_node
        units, node = units[todo], node[todo]
        while len(units):
            edge = self.back[node]
            found_u.append(units)
            found_p.append(self.ids[edge])
            node = self.start[edge]
            visited[node] = True
            todo = node > self.first_node[units]
            units, node = units[todo], node[todo]
        if not found_u:
            return np.zeros(0, np.int32), np.zeros(self.count + 1, np.int64), visited
        u, p = np.concatenate(found_u[::-1]), np.concatenate(found_p[::-1])
        order = np.argsort(u, kind="stable")
        return p[order], np.searchsorted(u[order], np.arange(self.count + 1)), visited

    def deviations(self, visited: np.ndarray) -> np.ndarray:
        """Smallest loss of a segmentation of each unit other than the best; inf if there is none."""
        out = np.full(self.count, np.inf)
        edge = np.flatnonzero(visited[self.end])
        edge = edge[self.back[self.end[edge]] != edge]
        loss = self.best[self.end[edge]] - self.best[self.start[edge]] - self.score[edge]
        np.minimum.at(out, self.owner[edge], loss)
        return out

    def incoming(self, unit: int) -> dict[int, list[int]]:
        if not hasattr(self, "_by_unit"):
            self._by_unit = np.argsort(self.owner, kind="stable")
            self._cut = np.searchsorted(self.owner[self._by_unit], np.arange(self.count + 1))
        into: dict[int, list[int]] = {}
        for e in self._by_unit[self._cut[unit] : self._cut[unit + 1]].tolist():
            into.setdefault(int(self.end[e]), []).append(e)
        return into

    def nbest(self, unit: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids) by backward A*; forward scores are the exact heuristic."""
        into, first, last = self.incoming(unit), int(self.first_node[unit]), int(self.last_node[unit])
        ticket = itertools.count()
        heap = [(-self.best[last], next(ticket), last, 0.0, None)]
        out: list[tuple[float, list[int]]] = []
        while heap and len(out) < n:
            f, _, node, g, path = heapq.heappop(heap)
            if node == first:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                out.append((-f, ids))
                continue
            for e in into.get(node, ()):
                before = int(self.start[e])
                if self.best[before] > -np.inf:
                    done = g + self.score[e]
                    heapq.heappush(heap, (-(done + self.best[before]), next(ticket), before, done, (int(self.ids[e]), path)))
        return out


def split_units(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Unit codes of all texts in order, the distinct units, and each text's first unit. A space is put in front."""
    padded = text_array(pc.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")))
    empty = np.asarray(pc.equal(pc.binary_length(column), 0))
    raw, offs = buffers(padded)
    space, feed = raw == 32, raw == 10
    cut = np.zeros(len(raw), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    cut[offs[:-1]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    codes, first = np.asarray(coded.indices).astype(np.int64), np.searchsorted(starts, offs)
    if empty.any():
        keep = np.ones(len(codes), bool)
        keep[first[:-1][empty]] = False
        first = np.append(0, np.cumsum(np.diff(first) - empty))
        codes = codes[keep]
    return codes, coded.dictionary, first


class Segmenter:
    """Segmentations of units, kept from batch to batch: a unit that comes again isn't segmented again."""

    def __init__(self, vocabulary: Vocabulary, units: int = KEPT_UNITS, size: int = KEPT_BYTES):
        self.vocabulary, self.trie, self.limit = vocabulary, Trie(vocabulary), (units, size)
        self.clear()

    def clear(self) -> None:
        self.units = pa.array([], pa.string())
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.lists: dict[int, list] = {}

    def segment(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best piece ids of all units in order, each unit's first, its score and its smallest deviation."""
        lattice = Lattices(units, self.vocabulary, self.trie)
        ids, at, visited = lattice.best_paths()
        return ids, at, lattice.best[lattice.last_node], lattice.deviations(visited)

    def find(self, units: pa.Array) -> np.ndarray:
        """The kept number of each unit; those that are new are segmented."""
        if len(self.units) > self.limit[0] or self.units.nbytes > self.limit[1]:
            self.clear()
        found = pc.index_in(units, value_set=self.units)
        if found.null_count:
            fresh_units = text_array(units.filter(pc.is_null(found)))
            ids, at, score, loss = self.segment(fresh_units)
            before = len(self.units)
            self.units = text_array(pa.concat_arrays([self.units, fresh_units]))
            self.at = np.append(self.at, at[1:] + self.at[-1])
            self.ids = np.append(self.ids, ids)
            self.score = np.append(self.score, score)
            self.loss = np.append(self.loss, loss)
            where = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
            where[where < 0] = np.arange(before, len(self.units))
            return where
        return np.asarray(found).astype(np.int64)

    def nbest(self, numbers: list[int], n: int) -> None:
        """Sees to it that `lists` has the n best segmentations of the kept units of these numbers."""
        todo = sorted({c for c in numbers if self.lists.get(c, ((), 0))[1] < n})
        if todo:
            lattice = Lattices(text_array(self.units.take(pa.array(todo))), self.vocabulary, self.trie)
            for k, c in enumerate(todo):
                self.lists[c] = (lattice.nbest(k, n), n)


class BestSegmenter(Segmenter):
    """The same best segmentations without lattices, for callers that want no further ones: there is no smallest deviation.

    Short units advance together, position by position: the pieces that start at a position are relaxed as the trie finds
    them, and nothing is kept of an edge that isn't the best into its node.  Nodes lie by position, and within one by the
    rank of the unit, longest first, so the units that reach a position are the first of all.
    """

    SHORT = 256

    def __init__(self, vocabulary: Vocabulary, units: int = KEPT_UNITS, size: int = KEPT_BYTES):
        super().__init__(vocabulary, units, size)
        self.width = np.array([len(p) for p in vocabulary.pieces])

    def segment(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.diff(buffers(units)[1])
        is_long = lengths > self.SHORT
        if not is_long.any():
            ids, at, score = self._short(units)
            return ids, at, score, np.full(len(units), np.inf)
        apart = [np.flatnonzero(~is_long), np.flatnonzero(is_long)]
        short, many = (text_array(units.take(pa.array(x))) for x in apart)
        found = self._short(short), super().segment(many)[:3]
        order = np.argsort(np.concatenate(apart))
        size = np.concatenate([np.diff(at) for _, at, _ in found])
        begin, size = (np.cumsum(size) - size)[order], size[order]
        at = np.append(0, np.cumsum(size))
        ids = np.concatenate([x for x, _, _ in found])[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
        return ids, at, np.concatenate([x for _, _, x in found])[order], np.full(len(units), np.inf)

    def _short(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, offs = buffers(units)
        trie, scores, lengths = self.trie, self.vocabulary.scores, np.diff(offs)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Units with a byte at each position, and where that position's bytes begin; a position's node lies before its byte.
        reach = np.append(len(units) - np.cumsum(np.bincount(lengths, minlength=1)), 0).tolist()
        byte_at = np.append(0, np.cumsum(reach)).tolist()
        node_at = [0, *(len(units) + b for b in byte_at)]
        place = np.arange(len(raw)) - np.repeat(offs[:-1], lengths)
        place = np.asarray(byte_at)[place] + np.repeat(rank, lengths)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        size, letters = np.zeros(len(raw), np.int64), np.empty(len(raw), np.int64)
        size[place[lead]] = np.diff(np.append(lead, len(raw)))
        letters[place] = raw
        loose = np.zeros(len(raw), bool)
        best, back = np.full(len(raw) + len(units), -np.inf), np.full(len(raw) + len(units), -1, np.int32)
        best[: len(units)] = 0

        def relax(position: int, unit: np.ndarray, value: np.ndarray, piece: np.ndarray) -> None:
            """Wider pieces come first, so that of equal scores the widest stays."""
            node = unit + node_at[position]
            better = np.flatnonzero(value > best.take(node))
            node = node.take(better)
            best[node] = value.take(better)
            back[node] = piece.take(better)

        for here in range(len(reach)):
            chars = size[byte_at[here] : byte_at[here] + reach[here]]
            unit = np.flatnonzero(chars)
            whole, rows, step = np.zeros(len(chars), bool), np.full(len(unit), trie.row[0]), 0
            while len(unit):
                node = trie.next[rows, letters.take(unit + byte_at[here + step])]
                hit = np.flatnonzero(node >= 0)
                unit, node, step = unit.take(hit), node.take(hit), step + 1
                piece = trie.piece.take(node)
                done = np.flatnonzero(piece >= 0)
                ends, piece = unit.take(done), piece.take(done)
                relax(here + step, ends, best.take(ends + node_at[here]) + scores.take(piece), piece)
                whole[ends[chars.take(ends) == step]] = True
                rows = trie.row.take(node)
                more = np.flatnonzero(rows[: np.searchsorted(unit, reach[here + step])])
                unit, rows = unit.take(more), rows.take(more)
            alone, k = np.flatnonzero((chars > 0) & ~whole), 0
            while len(alone):
                loose[byte_at[here + k] + alone] = True
                k += 1
                alone = alone[chars[alone] > k]
            unit = np.flatnonzero(loose[byte_at[here] : byte_at[here] + reach[here]])
            if len(unit):
                piece = self.vocabulary.byte_ids[letters[unit + byte_at[here]]]
                relax(here + 1, unit, best[unit + node_at[here]] + scores[piece], piece)
        where, position = np.arange(len(units)), lengths[order]
        score = best[np.asarray(node_at)[position] + where]
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        nodes = np.asarray(node_at)
        while len(where := where[position > 0]):
            position = position[position > 0]
            piece = back[nodes[position] + where]
            owners.append(order[where])
            found.append(piece)
            position = position - self.width[piece]
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(found[::-1])
        at = np.append(0, np.cumsum(np.bincount(owner, minlength=len(units))))
        return ids[np.argsort(owner, kind="stable")], at, score[rank]


_segmenters: dict[str, Segmenter] = {}


def segmenter(vocabulary: Vocabulary, kind: type[Segmenter] = Segmenter) -> Segmenter:
    """The worker's segmenter for this model file."""
    if type(_segmenters.get(vocabulary.path)) is not kind:
        _segmenters.clear()
        _segmenters[vocabulary.path] = kind(vocabulary)
    return _segmenters[vocabulary.path]


def encode_batch(column: pa.Array, segments: Segmenter, n: int = 1):
    """Flat ids and offsets by text, scores, and for n > 1 each text's further segmentations [(loss, edits)]."""
    codes, units, first = split_units(column)
    codes = segments.find(units)[codes]
    ids, at = segments.ids, segments.at
    size = np.diff(at)[codes]
    total = np.append(0, np.cumsum(size))
    flat = ids[np.repeat(at[codes] - total[:-1], size) + np.arange(total[-1])] if len(codes) else np.zeros(0, np.int32)
    score = segment_sum(segments.score[codes], first)
    others: list[list] = [[] for _ in range(len(first) - 1)]
    if n > 1 and len(codes):
        loss = segments.loss[codes]
        full = np.flatnonzero(np.diff(first) > 0)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        chosen: list[list[int]] = [[] for _ in range(len(first) - 1)]
        for _ in range(n - 1):
            low = np.full(len(first) - 1, np.inf)
            low[full] = np.minimum.reduceat(loss, first[full])
            hits = np.flatnonzero((loss == low[owner]) & np.isfinite(loss))
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])] if len(hits) else hits
            for h in hits.tolist():
                chosen[owner[h]].append(h)
            loss[hits] = np.inf
        segments.nbest([int(codes[s]) for spots in chosen for s in spots], n)
        for d, spots in enumerate(chosen):
            if not spots:
                continue
            lists = [segments.lists[int(codes[s])][0][:n] for s in spots]
            base = [found[0][0] for found in lists]
            combos = sorted(
                (sum(base) - sum(found[k][0] for found, k in zip(lists, ranks)), ranks) for ranks in itertools.product(*(range(len(found)) for found in lists))
            )
            start = total[first[d]]
            for less, ranks in combos[1:n]:
                edits = sorted((int(total[s] - start), int(size[s]), found[k][1]) for s, found, k in zip(spots, lists, ranks) if k)
                others[d].append((float(less), edits))
    return flat, total[first], score, others


def apply_edits(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of a further segmentation: each edit replaces `drop` ids at position `at`."""
    out = list(ids)
    for at, drop, new in sorted(edits, reverse=True):
        out[at : at + drop] = new
    return out


def decode_batch(flat: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """Texts of the ids."""
    table = pa.array(vocabulary.pieces, pa.binary())
    parts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pc.take(table, pa.array(flat)))
    joined = pc.binary_join(parts, pa.scalar(b"", pa.binary()))
    raw, offs = buffers(joined)
    front = offs[:-1][np.diff(offs) > 0]
    front = front[raw[front] == 32]
    kept = np.ones(len(raw), bool)
    kept[front] = False
    bounds = (offs - np.searchsorted(front, offs)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(joined), [None, pa.py_buffer(bounds), pa.py_buffer(raw[kept])]).cast(pa.string())


OTHERS = "array<struct<loss: double, edits: array<struct<at: int, drop: int, ids: array<int>>>>>"
_OTHERS = pa.list_(pa.struct([("loss", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, model: str | None = None, n: int = NBEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, score, others (further segmentations as edits of ids), exact (decoding gives the text back)."""
    vocabulary = Vocabulary(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = segmenter(vocabulary)
        for batch in sliced(batches, 1, SLICE):
            column = text_array(batch.column(1))
            none = np.asarray(batch.column(1).is_null())
            flat, offs, score, others = encode_batch(column, segments, n)
            back = decode_batch(flat, offs, vocabulary)
            mask = pa.array(none)
            ids = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat), mask=mask)
            more = [None if none[d] else [{"loss": x, "edits": [{"at": a, "drop": k, "ids": i} for a, k, i in e]} for x, e in o] for d, o in enumerate(others)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(np.diff(offs).astype(np.int32), mask=none), pa.array(np.round(score, 6), mask=none), pa.array(more, _OTHERS), pc.if_else(mask, pa.scalar(None, pa.bool_()), pc.equal(back, column))],
                ["doc_id", "ids", "n_pieces", "score", "others", "exact"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces int, score double, others {OTHERS}, exact boolean")


def add_ids(docs: DataFrame, model: str | None = None, text: str = "text", name: str = "piece_ids") -> DataFrame:
    """All rows and columns, with the ids of the best segmentation in a further column."""
    vocabulary = Vocabulary(model)
    at, name, names = docs.columns.index(text), fresh(docs, name), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = segmenter(vocabulary)
        for batch in sliced(batches, at, SLICE):
            flat, offs, _, _ = encode_batch(text_array(batch.column(at)), segments)
            ids = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat), mask=pa.array(np.asarray(batch.column(at).is_null())))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, name])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, model: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of id lists; null ids give a null text, unknown and control ids nothing."""
    vocabulary = Vocabulary(model)
    source = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            texts = decode_batch(np.asarray(lists.flatten()), np.append(0, np.cumsum(sizes)), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)], ["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, text string")
