"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text (FEATURES bins, square-rooted
counts scaled to unit length). Families come from the training rows: languages whose mean
vectors are more alike than languages are on average are joined, the most alike first, by
the average likeness of their members. One linear SVM for each pair of families votes for
the family; one for each pair of languages inside it votes for the language. Each pair is
fitted by a task of its own. The fit uses at most `per_language` rows of each language,
those with the smallest hash of doc_id: a bounded sample, and the only thing here that
does not cover all rows.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LOWER, SPACE, Shipped, as_bytes, crc_bucket, lean, small_batches, smallest

FEATURES = 4096
#: How much less likely a trigram of a text that is kept may be than an evenly drawn one, in nats.
SLACK = 0.5
LATIN = re.compile(rb"[A-Za-z]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def has_letter(text: bytes) -> bool:
    return bool(LATIN.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def features(texts: list[bytes]) -> np.ndarray:
    """A unit vector of hashed trigrams for each text, zero where it has under three bytes."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        for at in range(0, len(text), 1 << 20):
            b = LOWER[np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8)].astype(np.uint32)
            gram = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            row += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def bins(text: bytes) -> np.ndarray:
    """How many of the text's trigrams of letters and spaces, two letters at least, fall into each bin."""
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), 1 << 20):
        b = LOWER[np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8)]
        letter = ((b >= 97) & (b <= 122) | (b >= 128)).view(np.uint8)
        plain = letter.astype(bool) | SPACE[b]
        use = plain[:-2] & plain[1:-1] & plain[2:] & (letter[:-2] + letter[1:-1] + letter[2:] >= 2)
        b = b.astype(np.uint32)
        out += np.bincount(((b[:-2] << 16 | b[1:-1] << 8 | b[2:])[use] * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    return out


def packed(row: np.ndarray) -> bytes:
    """A row as compressed half floats; most of its bins are empty."""
    return zlib.compress(row.astype(np.float16).tobytes(), 1)


def unpacked(row: bytes) -> bytes:
    return zlib.decompress(row)


def some(x: np.ndarray | list[bytes], at: np.ndarray) -> np.ndarray:
    """The rows of x that are asked for: of an array, or of a list of packed() rows, which is never unpacked as a whole."""
    if isinstance(x, list):
        return np.array([np.frombuffer(unpacked(x[i]), np.float16) for i in np.flatnonzero(at)], np.float32)
    return x[at]


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighed evenly (accelerated gradient)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step, t = np.float32(1 / (1 + 4 * c)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        after = v - step * (v - np.float32(2 * c) * ((weight * slack * y) @ x))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = after, after + np.float32((before - 1) / t) * (after - w)
    return w[:-1], float(w[-1])


def families_of(likeness: np.ndarray) -> list[list[int]]:
    """Indices grouped by a symmetric table of likeness: the two most alike groups join while they are more alike, on average of their members, than two members are on average of all."""
    n = len(likeness)
    groups = [[i] for i in range(n)]
    usual = likeness[np.triu_indices(n, 1)].mean() if n > 1 else 0.0
    while len(groups) > 1:
        alike, a, b = max((likeness[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a, b in itertools.combinations(range(len(groups)), 2))
        if alike <= usual + 1e-9:
            break
        groups[-a] += groups.pop(-b)
    return [sorted(g) for g in groups]


def vote(x: np.ndarray, machines: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The winner's index and its score (0 to 1) by votes of squashed margins."""
    score = np.zeros((len(x), n))
    if n == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    for a, b, w, bias in machines:
        p = 1 / (1 + np.exp(-3 * np.clip(x @ w + bias, -20, 20)))
        score[:, a] += p
        score[:, b] += 1 - p
    score /= n - 1
    best = score.argmax(1)
    return best, score[np.arange(len(x)), best]


def fit_here(tasks: list, x: np.ndarray | list[bytes], of: np.ndarray, label: np.ndarray) -> list:
    """(level, a, b, weights, bias) of each task (level, a, b): level -1 tells families a and b apart, level k languages of family k."""
    out = []
    for level, a, b in tasks:
        kind = of if level < 0 else label
        rows = (kind == a) | (kind == b)
        out.append((level, a, b, *svm(some(x, rows), np.where(kind[rows] == a, 1.0, -1.0))))
    return out


class LanguageModel:
    """A family classifier and, in each family, a language classifier.

    With a session, each pair of classes is fitted by a task of its own; without one, here.
    x and counts are arrays, or lists of packed() rows, of which a language's are unpacked at a time.
    """

    def __init__(self, x: np.ndarray | list[bytes], langs: list[str], counts: np.ndarray | list[bytes] | None = None, spark=None):
        self.langs = sorted(set(langs))
        label = np.searchsorted(np.array(self.langs, object), np.array(langs, object))
        means = np.array([some(x, label == i).mean(0) for i in range(len(self.langs))])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        self.families = families_of(means @ means.T)
        of = np.zeros(len(self.langs), np.int64)
        for k, members in enumerate(self.families):
            of[members] = k
        tasks = [(-1, a, b) for a, b in itertools.combinations(range(len(self.families)), 2)]
        tasks += [(k, a, b) for k, members in enumerate(self.families) for a, b in itertools.combinations(members, 2)]
        fitted = self.spread(spark, tasks, x, of[label], label) if spark else fit_here(tasks, x, of[label], label)
        self.top = [m[1:] for m in fitted if m[0] < 0]
        place = {i: (k, j) for k, members in enumerate(self.families) for j, i in enumerate(members)}
        self.inner = [[(place[a][1], place[b][1], w, bias) for level, a, b, w, bias in fitted if level == k] for k in range(len(self.families))]
        #: log-share of each bin among a language's trigrams, and that of a bin drawn evenly.
        if counts is not None:
            total = np.array([some(counts, label == i).sum(0) for i in range(len(self.langs))], float) + 0.5
            self.log_share = np.log(total / total.sum(1, keepdims=True))

    @staticmethod
    def spread(spark, tasks: list, x: np.ndarray | list[bytes], of: np.ndarray, label: np.ndarray) -> list:
        """fit_here() of the tasks, dealt over the executors."""
        if not tasks:
            return []
        shipped = Shipped(spark, (tasks, x if isinstance(x, list) else [packed(r) for r in x], of, label))

        def run(batches):
            tasks, x, of, label = shipped.value
            for b in batches:
                got = fit_here([tasks[i] for i in b.column(0).to_pylist()], x, of, label)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.astype(np.float32).tobytes() for *_, w, _ in got], pa.binary()), pa.array([g[-1] for g in got], pa.float64())], ["task", "w", "bias"])

        rows = spark.range(0, len(tasks), 1, min(len(tasks), 512)).mapInArrow(lean(run, shipped), "task long, w binary, bias double").collect()
        shipped.box.destroy()
        return [(*tasks[r.task], np.frombuffer(r.w, np.float32), r.bias) for r in sorted(rows)]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = vote(x, self.top, len(self.families))
        lang = np.zeros(len(x), np.int64)
        for k, members in enumerate(self.families):
            if (rows := family == k).any():
                best, p = vote(x[rows], self.inner[k], len(members))
                lang[rows], sure[rows] = np.array(members)[best], sure[rows] * p
        return [self.langs[i] for i in lang], sure

    def belongs(self, text: bytes) -> bool:
        """Whether the text's trigrams fit a learned language: SLACK nats each, at most, less than trigrams drawn evenly from all bins. Too few to tell do."""
        n = bins(text)
        return bool(n.sum() < 8 or (self.log_share @ n).max() > -n.sum() * (np.log(FEATURES) + SLACK))


def fit(train: DataFrame, per_language: int = 500) -> LanguageModel | None:
    """A model from (doc_id, text, lang) rows; None where no row has a text with a letter and a language."""
    spark = train.sparkSession
    small_batches(spark)
    known = train.where("lang is not null and text is not null")
    ids = smallest(known.where("doc_id is not null"), "lang", per_language)

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(0))
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            x = [packed(r) for r in features([texts[i] for i in keep])]
            n = [packed(np.minimum(bins(texts[i]), 60000)) for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), pa.array(x, pa.binary()), pa.array(n, pa.binary())], ["lang", "x", "n"])

    rows = known.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").select("text", "lang").mapInArrow(lean(run), "lang string, x binary, n binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.lang)
    rows = [r for _, same in itertools.groupby(rows, lambda r: r.lang) for r in sorted(same, key=lambda r: (unpacked(r.x), unpacked(r.n)))]
    return LanguageModel([r.x for r in rows], [r.lang for r in rows], [r.n for r in rows], spark)


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str], schema: str) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score; schema names all of them."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = Shipped(spark, model)

    def run(batches):
        model = shipped.value
        for b in batches:
            texts = as_bytes(b.column("text"))
            lettered = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if lettered:
                got, sure = model.predict(features([texts[i] for i in lettered]))
                for i, y in zip(lettered, got):
                    lang[i] = y
                score[lettered] = sure
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, *({"text"} - set(keep))).mapInArrow(lean(run, shipped), schema)


def identify(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of documents.

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2 and whose lang is not
    null. A null text, or one without a letter, is `und` with score 0, and so is every
    text when there is nothing to learn from. Repeated rows stay; ties go to the first
    language in code point order; other columns are not read; an empty table gives an
    empty table. A sample that many rows of one doc_id share is still bounded by
    per_language ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", crc_bucket("doc_id", 4) == 2)
    model = fit(docs.where("not held_out"), per_language)
    return predict(docs, model, ["doc_id", "held_out"], SCHEMA)


def keep_identified(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """docs, all columns, lang as identified, without the rows that identification rejects: no letter, or no language that they belong to.

    lang becomes what identify() names, whatever it was, null included. A text belongs to no
    learned language if its letter trigrams are clearly likelier drawn evenly from all bins
    than from those of any language's training rows: lettered noise, or a script that no
    training row has. The machines always name some language, so their votes are no measure
    of that. Learns from the rows of docs themselves that have a lang, as identify() does;
    without any, nothing can be told apart: only texts without a letter go and lang stays.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shipped = Shipped(spark, fit(known.where(crc_bucket("doc_id", 4) != 2), per_language))
    at = [c.lower() for c in docs.columns].index("lang")

    def run(batches):
        model = shipped.value
        for b in batches:
            texts = as_bytes(b.column("text"))
            kept = [i for i, t in enumerate(texts) if has_letter(t)]
            if model:
                kept = [i for i in kept if model.belongs(texts[i])]
            out = b.take(pa.array(kept, pa.int64()))
            if model and kept:
                lang, _ = model.predict(features([texts[i] for i in kept]))
                out = out.set_column(at, out.schema.field(at), pa.array(lang, pa.string()).cast(out.schema.field(at).type))
            yield out

    return docs.mapInArrow(lean(run, shipped), docs.schema)
