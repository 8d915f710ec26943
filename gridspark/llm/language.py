"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by multiplying its letters' vectors, each
permuted (rotated) by its place; a text's profile is the sum (bundle) over its trigrams. A language's prototype is
the bundle of its training texts' unit profiles. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, fold, fresh, map_batches, per_process

DIMENSIONS, SEED = 1024, 7
UNKNOWN = "und"
#: Training texts of each language at most; the bound of the fit, not of what is predicted.
TRAIN_DOCS = 1500
#: Languages that are learned at most, the most frequent ones: each is a row on the driver and in every task.
LANGUAGES = 1000
#: Trigram vectors kept by a worker (1 KB each).
KEPT = 40_000


class Profiles:
    """Letter vectors and the bundles made of them."""

    def __init__(self):
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.is_letter = np.zeros(0x110000, dtype=bool)
        self._learn(range(256))
        self.letters: dict[int, np.ndarray] = {}
        self.row_of: dict[int, int] = {}
        self.rows = np.zeros((0, DIMENSIONS), dtype=np.int8)

    def _learn(self, codes) -> None:
        """Symbols of code points: letters and marks (which stand in words) are themselves, 0 is what separates words."""
        for code in codes:
            kind = unicodedata.category(chr(code))[0]
            self.symbol[code] = code if kind in "LM" else 0
            self.is_letter[code] = kind == "L"

    def letter(self, code: int) -> np.ndarray:
        known = self.letters.get(code)
        if known is None:
            known = self.letters[code] = np.random.default_rng((SEED, code)).choice(np.array([-1, 1], dtype=np.int8), DIMENSIONS)
        return known

    def _bound(self, trigram: int) -> np.ndarray:
        a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different letter trigrams (words padded by one separator) and how often each comes."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbol[codes]
        self._learn(np.unique(codes[symbols < 0]).tolist())
        if not self.is_letter[codes].any():  # marks alone are no letters
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s = self.symbol[codes].astype(np.int64)
        s = np.concatenate(([0], s, [0]))
        s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]
        if len(s) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)

    def profile(self, text: str) -> np.ndarray | None:
        """The bundle; None without a letter."""
        grams, counts = self.trigrams(text)
        if not len(grams):
            return None
        rows = list(map(self.row_of.get, grams.tolist()))
        if None in rows:
            new = [g for g, r in zip(grams.tolist(), rows) if r is None]
            if len(self.row_of) + len(new) > KEPT:
                self.row_of, self.rows = {}, self.rows[:0]
                new = grams.tolist()
            vectors = np.array([self._bound(g) for g in new], dtype=np.int8)
            at = len(self.row_of)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows[:at], vectors, np.zeros((at + len(new), DIMENSIONS), dtype=np.int8)))
            else:
                self.rows[at : at + len(new)] = vectors
            self.row_of.update((g, at + i) for i, g in enumerate(new))
            rows = list(map(self.row_of.get, grams.tolist()))
        return counts.astype(np.float32) @ self.rows[rows].astype(np.float32)


def shared_profiles() -> Profiles:
    return per_process("language-profiles", Profiles)


def fit(docs: DataFrame, usable, per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit rows), from about per_language texts of each language; of the LANGUAGES most frequent ones.

    usable: condition of the rows to learn from. The sample is those with the smallest hashes of the id, so it does
    not depend on partitions. Texts are read whole.
    """
    spark = docs.sparkSession
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    draw = (F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("draw")
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    share = spark.createDataFrame([(lang, per_language / n) for lang, n in counts.items()], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text", draw)
    bundles = {lang: [] for lang in counts}

    def profiles(batches):
        made = shared_profiles()
        for b in by_size(batches, 1):
            sums: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = made.profile(text)
                if p is not None:
                    held = sums.setdefault(lang, [0, np.zeros(DIMENSIONS)])
                    held[0] += 1
                    held[1] += p / (np.linalg.norm(p) or 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tolist() for _, v in sums.values()], pa.list_(pa.float64()))], names=["lang", "n", "sum"])

    for r in map_batches(drawn, profiles, "lang string, n long, sum array<double>").collect():  # a row for each batch of the sample
        bundles[r["lang"]].append(np.array(r["sum"]))
    names = sorted(lang for lang, found in bundles.items() if found)
    rows = np.array([np.sum(sorted(map(tuple, bundles[lang])), axis=0) for lang in names], dtype=np.float64).reshape(len(names), DIMENSIONS)
    return names, (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score (the cosine, cut to 0..1) of every whole text.

    und and 0 for a null text, one without a letter, or where no language was learned. Ties go to the first language
    in alphabetical order. Rows are independent; repeated rows get equal answers. Kept columns of the
    new names are replaced.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    chosen = docs.select(docs["text"].alias(fresh(docs, "body")[0]), *[docs[c] for c in keep])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        made = shared_profiles()
        for b in by_size(batches, 0):
            found, scores = [], []
            for text in b.column(0).to_pylist():
                p = made.profile(text) if text and names else None
                if p is None:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ p / (float(np.linalg.norm(p)) or 1.0)
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_batches(chosen, run, f"{schema}, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """Rows that language identification never learns from."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))
