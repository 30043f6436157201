"""Token ids in binary files: frequency-ranked, byte-aligned variable-length, with separate control bytes.

Every id becomes its rank by corpus frequency, so that common ids take one byte. Four ranks share a control byte of
2-bit lengths; their 1 to 4 bytes each stand apart from the control bytes. Decoding is numpy table lookup: control
byte -> four lengths -> offsets -> masked gathers. A file holds blocks of whole documents in ascending doc_id
order, and the files of a folder follow each other in that order. ranks.bin has the ids by rank.

Block: 8 bytes magic, then little-endian uint64 counts (documents, tokens, data bytes), then per document int64
doc_id, uint8 whether it is null, uint32 tokens (as three columns), then control bytes, then data bytes.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import Cache, as_batch, groups, only, table, two
from wardcraft.plans.files import Window, writer
from wardcraft.plans.shared import materialise, new_folder, remove

MAGIC, HEAD, END_ID, BLOCK_TOKENS, HELD = b"WCTOKEN1", struct.Struct("<8sQQQ"), 2, 1 << 20, 700_000
#: Bytes of text whose distinct words are looked up together.
GROUP = 12 << 20
#: New words that the library gets in one text.
LINES = 100
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: A space before white space or the end: there the words of a text may not be encoded apart.
ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}]|\pZ|$)"
APART = re.compile(r" (?=\S)")
#: Classes of bytes: letters, signs without the apostrophe (it takes some letters along), line breaks; 0 for all else.
LETTER, SIGN, BREAK = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[list(rb"!\"#$%&()*+,-./:;<=>?@[\]^_`{|}~")] = SIGN
KINDS[10] = BREAK
KINDS[65:91] = KINDS[97:123] = LETTER
LEADS = np.zeros(256, bool)
LEADS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True  # U+00C0 to U+024F and U+0400 to U+047F are letters but for two signs
KINDS[LEADS] = LETTER


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    most = int(length.max(initial=1))
    data = values.view(np.uint8).reshape(-1, 4)[:, :most][np.arange(most) < length[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length, dtype=np.int64) - length
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = d[start].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        more = np.flatnonzero(length > k)
        out[more] |= d[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[length]


def chosen(values: np.ndarray, edge: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[edge[k] : edge[k + 1]] for each k of code, one after the other, and where each begins, with the end of all.

    Places are 32-bit: there are fewer ids than bytes of text, of which an Arrow array of strings has less than 2 GB.
    """
    size = np.diff(edge).astype(np.int32)[code]
    ends = np.r_[np.int32(0), np.cumsum(size, dtype=np.int32)]
    at = np.repeat(edge[code].astype(np.int32) - ends[:-1], size)
    at += np.arange(len(at), dtype=np.int32)
    return values[at], ends


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


class Encoder:
    """Ids of texts by the tokenizers library, called once per distinct word.

    The byte-level pre-tokenizer always starts anew at a space that stands before a non-space, so the stretches between
    such spaces are encoded apart from each other; common ones are held with their ids. New ones go to the library
    together, each on a line of its own: it starts anew at line breaks too, and they come out as ids of their own.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.line = self._library("\n")
        self.first = Cache(lambda x: np.array(self._library(x), self.kind).tobytes(), HELD)
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, words: list[str], tails: list[str]) -> None:
        """Hold words as after a space, and tails as after a line break; all are printable."""
        if not (words or tails):
            return
        lines = [*[" " + x for x in words], *tails]
        some = self.library.encode_batch_fast(["\n".join(lines[k : k + LINES]) for k in range(0, len(lines), LINES)], add_special_tokens=False)
        ids = np.array([*itertools.chain.from_iterable([x.ids + self.line for x in some])][:-1], self.kind)
        cut = np.flatnonzero(ids == self.line[0]) * self.kind.itemsize
        raw = ids.tobytes()
        found = [raw[a:b] for a, b in zip([0, *(cut + self.kind.itemsize).tolist()], [*cut.tolist(), len(raw)], strict=True)]
        self.held.update(zip(words, found[: len(words)], strict=True))
        self.first.update(zip(tails, found[len(words) :], strict=True))

    def _new(self, words: set[str]) -> None:
        """Hold the ids of words, each as after a space; none is held yet. What stands behind a line break is encoded apart, as the pre-tokenizer does."""
        held, first, line = self.held, self.first, np.array(self.line, self.kind).tobytes()
        plain = {x for x in words if x.isalpha()}
        made, odd, stems, tails = [], [], set(), set()
        for x in words.difference(plain):
            head, broken, tail = x.partition("\n")
            if len(self.line) != 1 or not head.isprintable() or broken and not (head and tail and tail.isprintable()):
                odd.append(x)
                continue
            (stems if broken else plain).add(head)
            if broken:
                if tail not in first:
                    tails.add(tail)
                made.append((x, head, tail))
        stems = stems.difference(held)
        held.update([(x, self.older[x]) for x in stems if x in self.older])
        plain |= stems.difference(held)
        if len(self.line) == 1:
            self._plain(list(plain), list(tails))
        else:
            odd += plain
        for x, head, tail in made:
            held[x] = held[head] + line + first[tail]
        for x, found in zip(odd, self.library.encode_batch_fast([" " + x for x in odd], add_special_tokens=False), strict=True):
            held[x] = np.array(found.ids, self.kind).tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of words, each as after a space."""
        if len(self.held) >= HELD:
            self.older, self.held = self.held, {}
        if len(self.first) >= HELD // 4:
            self.first.clear()
        held, older = self.held, self.older
        held[""] = b""
        if need := set(words).difference(held):
            new = need.difference(older)
            held.update([(x, older[x]) for x in need.difference(new)])
            self._new(new)
        return list(map(held.__getitem__, words))

    def _after_break(self, words: list[str]) -> list[bytes]:
        """The ids of words, each as after a line break or signs."""
        if len(self.line) == 1:
            self._plain([], [x for x in {*words}.difference(self.first) if x and x.isprintable()])
        return [self.first[x] if x else b"" for x in words]

    def _words(self, words: pa.Array, spare: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of distinct words, each as after a space, one word after the other; where each begins; and those of spare ones.

        Of words of letters, signs and single line breaks, letters first, each such run is encoded apart.
        """
        edge, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1], words.buffers()[2]
        b = np.frombuffer(data, np.uint8)[: edge[-1]] if data else np.zeros(0, np.uint8)
        full = edge[:-1] < edge[1:]
        start = edge[:-1][full]
        kind = KINDS[b]
        before = np.r_[np.zeros(min(1, len(b)), np.uint8), b[:-1]]
        kind[(b & 0xC0 == 0x80) & LEADS[before] & ~((before == 0xC3) & (b & 0xDF == 0x97))] = LETTER
        same = np.r_[np.zeros(min(1, len(b)), bool), kind[1:] == kind[:-1]]
        wrong = np.r_[0, np.cumsum((kind == 0) | same & (kind == BREAK), dtype=np.int32)]
        apart = wrong[edge[1:]] == wrong[edge[:-1]]
        apart[full] &= kind[start] == LETTER
        cut = ~same & np.repeat(apart, np.diff(edge))
        cut[start] = True
        count = np.r_[0, np.cumsum(cut, dtype=np.int32)]
        at = np.r_[np.flatnonzero(cut), len(b)].astype(np.int32)
        runs = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), data])
        first = np.zeros(len(runs), bool)
        first[count[start]] = True
        stems, rest = (runs.filter(pa.array(x)).dictionary_encode() for x in (first, ~first))
        n = len(stems.dictionary)
        found = self._known([*stems.dictionary.to_pylist(), *spare])
        code = np.empty(len(runs), np.int32)
        code[first], code[~first] = stems.indices.to_numpy(), n + rest.indices.to_numpy()
        ids, ends = self._laid(found[:n] + self._after_break(rest.dictionary.to_pylist()), code)
        return ids, ends[count[edge]], found[n:]

    def _laid(self, rows: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows[k] for each k of code, and where each begins, with the end of all."""
        ends = np.cumsum(np.fromiter(map(len, rows), np.int32, len(rows)) // self.kind.itemsize, dtype=np.int32)
        return chosen(np.frombuffer(b"".join(rows), self.kind), np.r_[np.int32(0), ends], code)

    def ids(self, batch: list[str]) -> list[bytes]:
        """For each text its ids, as arrays of `kind`."""
        column = pa.array(batch, pa.string())
        strange = pc.match_substring_regex(column, ODD)
        odd = {k: APART.split(batch[k]) for k in np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()}
        parts = pc.split_pattern(pc.if_else(strange, "", column) if odd else column, " ")
        every = parts.flatten().dictionary_encode()  # the distinct words of all texts, and the place of each word among them
        edge = parts.offsets.to_numpy()
        heads = parts.flatten().take(pa.array(edge[:-1])).to_pylist()  # what stands before the first space has none in front
        spare = [x for p in odd.values() for x in p[1:]]
        ids, start, found = self._words(every.dictionary, spare)
        known = dict(zip(spare, found, strict=True))
        more, begin = self._laid(self._after_break(heads), np.arange(len(batch)))
        code = every.indices.to_numpy().astype(np.int32)
        code[edge[:-1]] = len(start) - 1 + np.arange(len(batch))
        ids, ends = chosen(np.concatenate([ids, more]), np.r_[start, len(ids) + begin[1:]], code)
        raw = ids.tobytes()
        cut = ends.astype(np.int64)[edge] * self.kind.itemsize
        out = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for k, p in odd.items():
            out[k] = (self.first[p[0]] if p[0] else b"") + b"".join([known[x] for x in p[1:]])
        return out


def encoder(path: str) -> Encoder:
    return only(("tokens", path), lambda: Encoder(path))


def _encode(path: str, end_id: int):
    """(doc_id, n, crc, ids) of each row; last, with n -1, the partition's count of each id."""

    def run(batches):
        kind, total = encoder(path).kind, np.zeros(1, np.int64)
        end = np.array([end_id], kind).tobytes()
        names, types = ["doc_id", "n", "crc", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for at, part in groups(batch, GROUP, rows=5000):
                ids = [x + end for x in encoder(path).ids(part)]
                n = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
                n[: len(total)] += total
                total = n
                yield as_batch(names, types, [batch.column("doc_id").slice(at, len(part)), [len(x) // kind.itemsize for x in ids], [zlib.crc32(x) for x in ids], ids])
        yield as_batch(names, types, [[None], [-1], [0], [total.tobytes()]])

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    """The n ids that _encode has written, in 2 or 4 bytes each."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _tally(batches):
    """(id, count) of one partition of counts; as many rows as the vocabulary at most."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            n = np.frombuffer(x, np.int64)
            total, n = (total, n) if len(total) >= len(n) else (n, total)
            total = total.copy()
            total[: len(n)] += n
    found = np.flatnonzero(total)
    yield as_batch(["id", "n"], [pa.int64()] * 2, [pa.array(found), pa.array(total[found])])


def _block(rows: list[tuple], rank: np.ndarray) -> bytes:
    ids = np.concatenate([r[1] for r in rows])
    control, data = pack(rank[ids])
    return b"".join([
        HEAD.pack(MAGIC, len(rows), len(ids), len(data)),
        np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
        np.array([r[0] is None for r in rows], np.uint8).tobytes(),
        np.array([len(r[1]) for r in rows], "<u4").tobytes(),
        control,
        data,
    ])


_MANIFEST = "part long, path string, documents long, tokens long, bytes long"


def _write(folder: str, rank, block_tokens: int):
    def run(batches):
        only(None)
        part = TaskContext.get().partitionId()
        path, rows, size = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.wctok", [], 0
        out, total = None, [0, 0, 0]

        def flush():
            found = _block(rows, rank.value)
            out.write(found)
            for k, n in enumerate((len(rows), size, len(found))):
                total[k] += n
            rows.clear()

        for batch in batches:
            for doc_id, packed, n in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "ids", "n")], strict=True):
                out = out or writer(path)
                rows.append((doc_id, _ids(packed, n)))
                size += n
                if size >= block_tokens:
                    flush()
                    size = 0
        if rows:
            flush()
        if out:
            out.close()
            yield as_batch(["part", "path", "documents", "tokens", "bytes"], [pa.int64(), pa.string(), *[pa.int64()] * 3], [[part], [path], *[[n] for n in total]])

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode every document, append end_id, write the files and return their folder.

    Null texts count as empty; rows without a doc_id come first; repeated ids follow each other by content. A retried
    task writes a file of a new name: manifest.parquet names the files that count, in order, with their tokens.
    """
    folder = folder or new_folder(spark, "tokens")
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    encoded = materialise(spark, two(docs).mapInArrow(_encode(path, end_id), "doc_id long, n long, crc long, ids binary"), "encoded")
    counts = encoded.where("n = -1").select("ids").mapInArrow(_tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # vocabulary rows
    size = max([tokenizer(path).get_vocab_size(), *[r.id + 1 for r in counts]])
    count = np.zeros(size, np.int64)
    for r in counts:
        count[r.id] = r.n
    by_rank = np.lexsort((np.arange(size), -count)).astype("<u4")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    with writer(f"{folder}/ranks.bin") as f:
        f.write(by_rank.tobytes())
    key = ("doc_id", "crc", "n")
    encoded.where("n >= 0").repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_write(folder, spark.sparkContext.broadcast(rank), block_tokens), _MANIFEST).write.parquet(f"{folder}/manifest.parquet")
    remove(spark, encoded)
    return folder


def blocks(path: str, by_rank: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, tokens of each, ids of all) of each block of a file."""
    file, at = Window(path, 1 << 22), 0
    while at < file.size:
        magic, docs, n, data = HEAD.unpack(file.read(at, HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: no block at {at}")
        at += HEAD.size
        cols = file.read(at, 13 * docs)
        null = np.frombuffer(cols, np.uint8, docs, 8 * docs)
        doc_ids = [None if z else x for x, z in zip(np.frombuffer(cols, "<i8", docs).tolist(), null.tolist(), strict=True)]
        at += 13 * docs
        control = file.read(at, -(-n // 4))
        values = unpack(control, file.read(at + len(control), data), n)
        at += len(control) + data
        yield doc_ids, np.frombuffer(cols, "<u4", docs, 9 * docs).astype(np.int64), by_rank[values]
    file.close()


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless ids is false) ids of each document of a folder, by the files alone."""
    manifest = spark.read.parquet(f"{folder}/manifest.parquet").orderBy("part").select("path", "tokens").collect()  # a row per file
    rows, start = [], 0
    for r in manifest:
        rows.append((r.path, start))
        start += r.tokens
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if ids else {})

    def run(batches):
        only(None)
        file = Window(f"{folder}/ranks.bin")
        by_rank = np.frombuffer(file.read(0, file.size), "<u4")
        file.close()
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for doc_ids, lengths, found in blocks(path, by_rank):
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    crc = [zlib.crc32(found[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(found.astype(np.int32)))] if ids else []
                    yield as_batch(list(kinds), list(kinds.values()), [doc_ids, pa.array(starts + at), pa.array(lengths), crc, *lists])
                    at += int(lengths.sum())

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    plan = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return plan.mapInArrow(run, schema)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(spark, table(spark, sf_dir, "documents")), ids=False)
