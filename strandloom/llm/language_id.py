"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters, rotated
by their place; a document's vector bundles (adds) its trigrams' vectors over the whole text; a language's prototype
bundles unit vectors of labelled documents. Documents are compared with prototypes by cosine, after the mean prototype,
which all languages share, has been taken from both. Some language always has a cosine above zero then, so whether a text
is in a learned language at all is decided by its product with the prototype before that (``LEAST_LIKENESS``).

Prototypes are fitted on a bounded sample of the labelled rows: about ``PER_LANGUAGE`` of each language, chosen by a hash
of the id; prediction reads nothing but the text. Sums are in whole numbers, so results do not depend on partitions.

Text is lower-cased; every run of other characters counts as one blank, also at both ends. Letters are folded to
``FOLD`` vectors by code point, which keeps all alphabets up to U+0FFF apart. Defined cases: null texts and texts without
letters are ``und`` with score 0; of equal cosines the first language by code point wins; without any labelled row
everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, type_of

DIM = 1024
FOLD = 4096
PER_LANGUAGE = 2000
UNIT = 1 << 20
UNKNOWN = "und"
#: A text is like a language if its trigrams' mean product with the prototype, which does not depend on the text's length, is this
#: share of what the labelled documents have on average; by chance n trigrams miss their mean by about SHORT_SLACK / sqrt(n).
LEAST_LIKENESS = 0.3
SHORT_SLACK = 0.5
_PIECE = 1 << 20
_GRAMS = 4096

_state: dict = {}


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Code point to symbol (0 for what is no letter), and the letters' vectors rotated by 0, 1 and 2; once a process."""
    if not _state:
        symbol = np.zeros(0x110000, np.int64)
        letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        symbol[letters] = letters % (FOLD - 1) + 1
        first = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (FOLD, DIM))
        _state["tables"] = symbol, [np.roll(first, r, axis=1) for r in (0, 1, 2)]
    return _state["tables"]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams as numbers in base FOLD, and their counts; none without letters."""
    symbol, _ = _tables()
    text = (text or "").lower()
    keys, counts, tail = [], [], np.zeros(1, np.int64)
    for at in range(0, len(text), _PIECE):
        s = symbol[np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate([tail, s, [0]] if at + _PIECE >= len(text) else [tail, s])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one blank for each run
        tail = s[-2:]
        if len(s) >= 3:
            k, c = np.unique((s[:-2] * FOLD + s[1:-1]) * FOLD + s[2:], return_counts=True)
            keys.append(k)
            counts.append(c)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def summed(text: str | None) -> tuple[np.ndarray, int]:
    """The sum of a document's trigrams' vectors, and how many trigrams it has."""
    keys, counts = trigrams(text)
    _, (r0, r1, r2) = _tables()
    total = np.zeros(DIM, np.float64)
    for at in range(0, len(keys), _GRAMS):
        k = keys[at : at + _GRAMS]
        bound = r2[k // (FOLD * FOLD)] * r1[k // FOLD % FOLD] * r0[k % FOLD]
        total += counts[at : at + _GRAMS].astype(np.float32) @ bound.astype(np.float32)
    return total, int(counts.sum())


def bundle(text: str | None) -> np.ndarray | None:
    """A document's unit vector, or None without letters."""
    total, _ = summed(text)
    size = np.linalg.norm(total)
    return total / size if size else None


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their prototypes, and the mean product of their documents' trigrams with them, from ``text, lang`` rows."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                v, n = summed(text)
                if size := np.linalg.norm(v):
                    row = np.concatenate([v / size, v / n, [1.0]])
                    total[lang] = total.get(lang, 0) + np.rint(row * UNIT).astype(np.int64)
        rows = [(lang, i, int(x)) for lang, v in total.items() for i, x in enumerate(v)]
        yield pd.DataFrame(rows, columns=["lang", "i", "x"])

    per_task = labelled.select("text", "lang").mapInPandas(sums, "lang string, i int, x bigint")
    rows = per_task.groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()  # 2 * DIM + 1 rows a language
    langs = sorted(set(rows["lang"]))
    sums_of = np.zeros((len(langs), 2 * DIM + 1))
    sums_of[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["i"].to_numpy(int)] = rows["x"].to_numpy(float)
    p = sums_of[:, :DIM] / np.maximum(np.linalg.norm(sums_of[:, :DIM], axis=1, keepdims=True), 1e-12)
    return langs, p, (sums_of[:, DIM : 2 * DIM] * p).sum(axis=1) / np.maximum(sums_of[:, -1], 1)


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of doc_id."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled
    top = 1 << 30
    limit = labelled.sparkSession.createDataFrame([(k, int(min(1.0, per_language / n) * top)) for k, n in sizes.items()], "s_lang string, limit bigint")
    chosen = labelled.join(F.broadcast(limit), F.col("lang") == F.col("s_lang"))  # one row a language
    return chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(top)) < F.col("limit")).select("text", "lang")


def held_out() -> Column:
    """Whether a row is kept from training: the CRC-32 of its id leaves remainder 1 by 3."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Model:
    """Prototypes ready for prediction."""

    def __init__(self, langs: list[str], prototypes: np.ndarray, own: np.ndarray):
        self.langs = langs
        self.prototypes, self.own = prototypes, np.maximum(own, 1e-12)
        self.mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
        centred = prototypes - self.mean
        self.rows = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; the score maps the cosine from -1..1 to 0..1."""
        return self.judged(text)[:2]

    def judged(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is like the labelled documents of that language."""
        total, n = summed(text) if self.langs else (np.zeros(DIM), 0)
        size = np.linalg.norm(total)
        if not size:
            return UNKNOWN, 0.0, False
        v = total / size - self.mean
        cosines = np.round(self.rows @ v / max(np.linalg.norm(v), 1e-12), 9)
        best = int(np.argmax(cosines))
        like = total @ self.prototypes[best] / n / self.own[best]
        score = float(round(min(1.0, max(0.0, (1 + cosines[best]) / 2)), 9))
        return self.langs[best], score, bool(round(like, 9) >= LEAST_LIKENESS - SHORT_SLACK / n**0.5)


def train(docs: DataFrame) -> Model:
    """Prototypes from the rows of ``docs`` that have a language and are not held out."""
    return Model(*fit(sample(docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def one(doc_id, held, text):
        yield (doc_id, held, *sent.value.predict(text))

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_rows(rows, ["doc_id", "held_out", "text"], one, f"doc_id {type_of(docs, 'doc_id')}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is unknown: no letters, or like no learned language."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def one(*values):
        if sent.value.judged(values[at])[2]:
            yield values

    return map_rows(docs, docs.columns, one, docs.schema)
