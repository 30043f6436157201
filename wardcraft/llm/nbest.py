"""SentencePiece encoding and decoding with N-best segmentations.

Over the lattice of a segment a forward Viterbi pass gives the best score from the start to each position. A
backward A* search from the end uses these as its heuristic; they are exact, so paths come out best first and no
node is opened in vain. A text is a chain of independent segments (see lattice.py), so its N best segmentations
replace the best path in some segments by a later one; only the N - 1 segments whose second path costs least can
differ from their best.
"""

from __future__ import annotations

import heapq
import itertools
import struct
import zlib
from array import array
from heapq import heapify, heappop, heappush, heappushpop
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardcraft.llm.lattice import Pieces, default_model, pieces, segments
from wardcraft.llm.text import Cache, as_batch, only, slices, table, texts, two

#: Segments above LONGEST characters aren't held, so that what is held is bounded in bytes.
NBEST, HELD, LONGEST = 3, 400_000, 256
#: What is held of a segment: its best score and what its second path costs; then the ids. One bytes object takes half the memory of a tuple.
ENTRY = struct.Struct("<dd")


def _forward(vocabulary: Pieces, segment: str) -> list[list[tuple[float, int, int]]]:
    """Of each position its edges as (cost of the best path over the edge, its start, its piece); -1 - start for a character without one."""
    best: list[float] = [0.0] + [1e300] * len(segment)
    into: list[list[tuple[float, int, int]]] = [[] for _ in best]
    single, found = vocabulary.single, vocabulary.finder.iter(segment)
    if not single.issuperset(segment):
        found = sorted([*found, *[(k, (1, -1 - k, -vocabulary.unknown)) for k, char in enumerate(segment) if char not in single]], key=itemgetter(0))
    for end, (length, piece, cost) in found:
        end += 1
        i = end - length
        cost += best[i]
        into[end].append((cost, i, piece))
        if cost < best[end]:
            best[end] = cost
    return into


def _first(vocabulary: Pieces, into: list, opened: list[int] | None = None) -> tuple[float, tuple, list[tuple]]:
    """The search up to its first answer: (cost, path, entries left over). As the heuristic is exact, the least entry goes straight to the start.

    An entry is a path up to a position and one edge on from there: (cost of the best path with both, count, position, edge, cost
    of the path, path). The least one that is left over has the cost of the second answer.
    """
    scores, low = vocabulary.scores, vocabulary.unknown
    at, suffix, path, left = len(into) - 1, 0.0, None, []
    f = None
    while at:
        own = into[at]
        own.sort()
        if opened is not None:
            opened[at] = 1
        if len(own) > 1:
            left.append((own[1][0] - suffix, len(left), at, 1, suffix, path))
        cost, at, piece = own[0]
        f = cost - suffix
        suffix += scores[piece] if piece >= 0 else low
        path = (piece, path)
    return f, path, left


def _ids(vocabulary: Pieces, segment: str, path: tuple | None) -> list[int]:
    ids: list[int] = []
    while path:
        piece, path = path
        if piece >= 0:
            ids.append(piece)
        else:
            ids += [vocabulary.bytes[b] for b in segment[-1 - piece].encode("utf-8", "replace")]
    return ids


def segment_nbest(vocabulary: Pieces, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of a segment, best first; fewer if it has fewer paths.

    The next edge of an entry goes on the heap when the entry is taken. Of the paths up to a position only the first n can
    be part of an answer, so a run of equal characters, whose paths tie, opens n of them a position and not all: time and
    memory grow with n times the length.
    """
    scores, low = vocabulary.scores, vocabulary.unknown
    into, opened = _forward(vocabulary, segment), [0] * (len(segment) + 1)
    f, path, heap = _first(vocabulary, into, opened)
    out = [(-f, tuple(_ids(vocabulary, segment, path)))]
    count = len(heap)
    heapify(heap)
    while heap and len(out) < n:
        f, _, at, k, suffix, path = heappop(heap)
        while True:
            own = into[at]
            if k + 1 < len(own):
                count += 1
                heappush(heap, (own[k + 1][0] - suffix, count, at, k + 1, suffix, path))
            _, at, piece = own[k]
            suffix += scores[piece] if piece >= 0 else low
            path = (piece, path)
            if not at:
                out.append((-f, tuple(_ids(vocabulary, segment, path))))
                break
            if opened[at] >= n:
                break
            if not opened[at]:
                into[at].sort()
            opened[at] += 1
            count += 1
            f, _, at, k, suffix, path = heappushpop(heap, (into[at][0][0] - suffix, count, at, 0, suffix, path))
    return out


def _entry(vocabulary: Pieces):
    """Of a segment, an ENTRY and its ids; made of its parts between forced boundaries, which repeat more often."""

    def part(text: str) -> bytes:
        f, path, left = _first(vocabulary, _forward(vocabulary, text))
        return ENTRY.pack(-f, (min(left)[0] - f) if left else float("inf")) + array("I", _ids(vocabulary, text, path)).tobytes()

    parts = Cache(part, HELD // 2, LONGEST)

    def make(segment: str) -> bytes:
        cut = vocabulary.split(segment)
        if len(cut) == 1:
            return parts[segment]
        found = [parts[x] for x in cut]
        heads = [ENTRY.unpack_from(x) for x in found]
        return ENTRY.pack(sum([x[0] for x in heads]), min([x[1] for x in heads])) + b"".join([x[16:] for x in found])

    return make


def _opened(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best scores, costs of second paths, all ids) of entries."""
    flat = np.frombuffer(b"".join(found), np.uint32)
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    heads = (np.cumsum(size) - size)[:, None] + np.arange(ENTRY.size // 4)
    both = flat[heads].view("<f8")
    rest = np.ones(len(flat), bool)
    rest[heads] = False
    return both[:, 0], both[:, 1], flat[rest]


def _cache(path: str) -> Cache:
    return only(("nbest", path), lambda: Cache(_entry(pieces(path)), HELD, LONGEST))


def encode_nbest(text: str, n: int = NBEST, path: str | None = None) -> list[tuple[float, list[int]]]:
    """The n best (score, ids) of a whole text, best first. The empty text has one segmentation, without pieces."""
    path = path or default_model()
    parts = segments(text)
    found = [_cache(path)[x] for x in parts]
    best, costs, _ = _opened(found)
    total = float(best.sum())
    open_ = _cheapest(costs, n - 1) if found else []
    options = [segment_nbest(pieces(path), parts[k], n) for k in open_]
    combos = heapq.nsmallest(n, ((sum(o[0][0] - o[c][0] for o, c in zip(options, choice, strict=True)), choice) for choice in itertools.product(*[range(len(o)) for o in options])))
    out = []
    for cost, choice in combos:
        changed = {k: o[c][1] for k, o, c in zip(open_, options, choice, strict=True)}
        ids = b"".join([array("I", changed[k]).tobytes() if k in changed else x[16:] for k, x in enumerate(found)])
        out.append((total - cost, array("I", ids).tolist()))
    return out


def _cheapest(costs: np.ndarray, n: int) -> list[int]:
    """Places of the n least finite costs, the first on a tie."""
    out, costs = [], costs.copy()
    for _ in range(n):
        k = int(costs.argmin())
        if costs[k] == np.inf:
            break
        out.append(k)
        costs[k] = np.inf
    return out


def _digest(text: str, n: int, held: Cache, vocabulary: Pieces) -> tuple:
    """(n_pieces, scores of the n best, crc32 of the best ids, whether they decode to the text)."""
    parts = segments(text)
    if not parts:
        return 0, [0.0] + [None] * (n - 1), 0, True
    found = [held[x] for x in parts]
    best, costs, ids = _opened(found)
    total = float(best.sum())
    sums = [0.0]
    for k in _cheapest(costs, n - 1):
        o = [x[0] for x in segment_nbest(vocabulary, parts[k], n)]
        sums = heapq.nsmallest(n, [s + o[0] - x for s in sums for x in o])
    scores = [total - s for s in sums]
    return len(ids), scores + [None] * (n - len(scores)), zlib.crc32(ids), vocabulary.decode(ids) == text


def encode_documents(docs: DataFrame, n: int = NBEST, model: str | None = None) -> DataFrame:
    """documents -> doc_id, n_pieces, ids_crc32, scores array (n best totals, best first; null past the last), round_trip.

    One row per row. A null or empty text has no pieces and one segmentation of score 0. ids_crc32 is taken over the
    best segmentation's ids as little-endian unsigned 32-bit integers; round_trip says that they decode to the text.
    Characters without a piece become byte pieces. Ties go by search order, which depends on the text alone.
    Repeated rows give repeated rows; a null doc_id is kept; other columns are ignored.
    """
    model = model or default_model()

    def run(batches):
        held, vocabulary = _cache(model), pieces(model)
        names, types = ["doc_id", "n_pieces", "ids_crc32", "scores", "round_trip"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_()]
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [_digest(x.decode(), n, held, vocabulary) for x in texts(batch)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield as_batch(names, types, [batch.column("doc_id"), cols[0], cols[2], cols[1], cols[3]])

    return two(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, round_trip boolean")


def encode(docs: DataFrame, n: int = NBEST, model: str | None = None) -> DataFrame:
    """documents -> doc_id, segmentations array of (score, ids, text decoded from them): the n best, in full.

    One row per row. A null or empty text has one segmentation without pieces, of score 0; ties go by search order, which depends on the text
    alone; a text of any length is taken whole; repeated rows are repeated; a null doc_id is kept; other columns are ignored.
    """
    model = model or default_model()

    def run(batches):
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))
        for batch in (part for whole in batches for part in slices(whole, 100)):
            rows = [[{"score": s, "ids": ids, "decoded": pieces(model).decode(ids)} for s, ids in encode_nbest(x.decode(), n, model)] for x in texts(batch)]
            yield as_batch(["doc_id", "segmentations"], [pa.int64(), kind], [batch.column("doc_id"), rows])

    return two(docs).mapInArrow(run, "doc_id long, segmentations array<struct<score double, ids array<int>, decoded string>>")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
