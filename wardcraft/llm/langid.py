"""Language ID by unigram models over a fixed public vocabulary, with the segmentation summed out.

Each language has a probability for every piece. A segment's likelihood is the sum over all of its segmentations
of the product of piece probabilities, by the forward algorithm; a text's is the product over its segments
(independent, see lattice.py). The probabilities are learned by expectation maximisation over all segmentations of
the words of a bounded sample: about `per_language` distinct texts of each language.

Where no piece crosses two characters every segmentation has a boundary between them, so a segment's sum is the product
of those of its parts (`Pieces.split`). Parts of any length are summed in time linear in it, scaled along the way.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.lattice import default_model, piece_table, pieces, segments
from wardcraft.llm.text import as_batch, groups, is_held_out, only, table

PER_LANGUAGE, ROUNDS, HELD, SHORT, TINY = 300, 3, 400_000, 32, 1e-100
#: Added to each piece's expected count.
PRIOR = 0.02


def _expected(vocabulary, counts: dict[str, int], p: np.ndarray, unknown: float) -> np.ndarray:
    """Expected piece counts of parts with counts, by forward and backward sums. A sum of exponent k stands for itself times TINY ** k, so that none runs out of range."""
    out = np.zeros(len(p))
    prob, longest = p.tolist(), vocabulary.longest
    for part, times in counts.items():
        n = len(part)
        edges = vocabulary.edges(part)
        a, up = [1.0] + [0.0] * n, [0] * (n + 1)
        at = k = 0
        for i, j, piece in edges:
            if i != at:
                at = i
                if a[i] < TINY:  # all that is still open is scaled up
                    k += 1
                    a[i : i + longest + 1] = [x / TINY for x in a[i : i + longest + 1]]
                up[i] = k
            a[j] += a[i] * (prob[piece] if piece >= 0 else unknown)
        up[n] = k
        b, down = [0.0] * n + [1.0], [0] * (n + 1)
        at, k = n, 0
        for i, j, piece in reversed(edges):
            if i != at:
                if b[at] < TINY:
                    k += 1
                    b[at] /= TINY
                down[at], at = k, i
            b[i] += b[j] * TINY ** (down[j] - k) * (prob[piece] if piece >= 0 else unknown)
        for i, j, piece in edges:
            if piece >= 0:
                out[piece] += a[i] * prob[piece] * b[j] / a[n] * TINY ** (up[i] + down[j] - up[n]) * times
    return out


class Model:
    """Languages, piece probabilities of each, and the probability of a character without a piece."""

    def __init__(self, path: str, languages: list[str], probabilities: np.ndarray, unknown: float = 1e-7):
        self.path, self.languages, self.unknown = path, languages, unknown
        self.probabilities = probabilities.astype(np.float32)
        self.name = zlib.crc32(self.probabilities.tobytes())

    def part(self, part: str, columns: np.ndarray) -> np.ndarray:
        """Log-likelihood of a part of any length in each language. columns: of each, probabilities by piece."""
        edges, n, longest = pieces(self.path).edges(part), len(part), pieces(self.path).longest
        a, log = np.zeros((n + 1, len(self.languages))), np.zeros(len(self.languages))
        a[0], at = 1.0, 0
        for i, j, piece in edges:
            if i != at:
                at = i
                if a[i].min() < TINY:  # all that is still open is scaled up
                    low = np.maximum(a[i], 1e-300)
                    log += np.log(low)
                    a[i : i + longest + 1] /= low
            a[j] += a[i] * (columns[piece] if piece >= 0 else self.unknown)
        return log + np.log(np.maximum(a[n], 1e-300))

    def segment(self, segment: str) -> np.ndarray:
        """Log-likelihood of a segment in each language."""
        columns = self.probabilities.T.astype(float)
        return np.sum([self.part(x, columns) for x in pieces(self.path).split(segment)], 0)

    def _many(self, new: list[str], columns: np.ndarray) -> dict[str, bytes]:
        """Log-likelihoods of parts, many at once where they are short enough not to run out of range."""
        found, size = {}, 8 * len(self.languages)
        new.sort(key=len)
        short = bisect.bisect_right(new, SHORT, key=len)
        for k in range(0, short, 4096):
            part = new[k : min(short, k + 4096)]
            raw = piece_table(self.path).forward(part, columns, self.unknown).tobytes()
            found.update(zip(part, [raw[a : a + size] for a in range(0, len(raw), size)], strict=True))
        found.update((x, self.part(x, columns).tobytes()) for x in new[short:])
        return found

    def _hold(self, new: list[str], held: dict[str, bytes], columns: np.ndarray) -> None:
        """Log-likelihoods of segments; long ones by their parts."""
        long = {x: pieces(self.path).split(x) for x in new if len(x) > SHORT}
        found = self._many([x for x in new if len(x) <= SHORT], columns)
        held.update(found)
        parts = self._many(list(set().union(*long.values()).difference(found)), columns) | found if long else found
        for x, of in long.items():
            held[x] = np.frombuffer(b"".join([parts[y] for y in of])).reshape(len(of), -1).sum(0).tobytes()

    def scores(self, texts_: list[str]) -> list[np.ndarray]:
        """Log-likelihood of each text in each language."""
        kept = only(("langid", self.name), lambda: [np.ascontiguousarray(self.probabilities.T, float), {}, {}])
        if len(kept[1]) >= HELD:
            kept[1:] = [{}, kept[1]]
        columns, held, older = kept
        parts = [segments(x) for x in texts_]
        need = set().union(*parts).difference(held)
        if need:
            new = need.difference(older)
            held.update([(x, older[x]) for x in need.difference(new)])
            self._hold(list(new), held, columns)
        get, width = held.__getitem__, len(self.languages)
        return [np.frombuffer(b"".join(map(get, p))).reshape(-1, width).sum(0) for p in parts]

    def predict(self, texts_: list[str]) -> list[tuple[str, float]]:
        """(language, its posterior with equal priors) of each text; ties go to the first by name; `und`, 0 without a letter."""
        out = []
        for x, s in zip(texts_, self.scores(texts_) if self.languages else [None] * len(texts_), strict=True):
            if s is None or not any(map(str.isalpha, x)):
                out.append(("und", 0.0))
            else:
                k = int(s.argmax())
                out.append((self.languages[k], float(1 / np.exp(np.minimum(s - s[k], 0)).sum())))
        return out


def _count(path: str):
    def run(batches):
        """Parts of each language with their counts; bounded by the sample."""
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = found.setdefault(lang, Counter())
                for segment, n in Counter(segments(text)).items():
                    for part in pieces(path).split(segment):
                        own[part] += n
        for lang, counts in found.items():
            yield as_batch(["lang", "part", "n"], [pa.string(), pa.string(), pa.int64()], [[lang] * len(counts), list(counts), list(counts.values())])

    return run


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, model: str | None = None) -> Model:
    """A model from train(text, lang); rows without either are left out, other columns ignored; an empty table gives a model without languages.

    Distinct texts are sampled by a hash, each language at the rate that leaves about `per_language` of them, so a text that is repeated
    counts once and a language with fewer is taken whole. What comes to the driver are the sample's distinct parts with their counts.
    """
    path = model or default_model()
    vocabulary = pieces(path)
    train = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model(path, [], np.zeros((0, len(vocabulary.scores))))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / max(n, 1)))]), F.col("lang"))
    sample = train.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < rate).dropDuplicates(["lang", "h"])
    counts = sample.select("lang", "text").mapInArrow(_count(path), "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))
    by: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for lang, part, n in counts.toPandas().itertuples(index=False):
        by[lang][part] = n
    languages, usable = sorted(sizes), np.zeros(len(vocabulary.scores), bool)
    usable[list(vocabulary.ids.values())] = True
    out = np.zeros((len(languages), len(usable)))
    for k, lang in enumerate(languages):
        p = usable / usable.sum()
        for _ in range(rounds):
            c = (_expected(vocabulary, dict(sorted(by[lang].items())), p, 1e-7) + PRIOR) * usable
            p = c / c.sum()
        out[k] = p
    return Model(path, languages, out)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score. One row per row; null or letterless texts are `und` with score 0; a null doc_id counts as the empty text for held_out."""
    held = spark.sparkContext.broadcast(model)  # languages x vocabulary floats, whatever the corpus

    def run(batches):
        for batch in batches:
            for at, part in groups(batch):
                rows, own = held.value.predict(part), batch.slice(at, len(part))
                yield as_batch(["doc_id", "held_out", "lang_pred", "score"], [pa.int64(), pa.bool_(), pa.string(), pa.float64()], [own.column("doc_id"), own.column("held_out"), [r[0] for r in rows], [r[1] for r in rows]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs, with all their columns, whose language is known with a posterior of `least` or more.

    Rows whose text is null, empty or without a letter go; repeated rows stay or go together; a null doc_id makes no difference; an empty table gives no rows.
    """
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at, part in groups(batch):
                yield batch.slice(at, len(part)).filter(pa.array([p[0] != "und" and p[1] >= least for p in held.value.predict(part)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(spark, docs, fit(docs.where(~is_held_out(F.col("doc_id")))))
