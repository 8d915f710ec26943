"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. Each window of a text is
compressed with the ordinary dictionary alone and with the toxic one laid beside it; a window is the more toxic
the shorter the second is than the first. (With the toxic dictionary by itself, the lengths of ordinary words, which
each dictionary holds by chance, drown the few bytes that a toxic word saves; the README has the figures.) A document's
windows are summed up by the largest difference, the windows
over the threshold and their share, and turned to a probability by a logistic curve that was fitted on labelled
documents under dictionaries which had not seen them.

What goes into the toxic dictionary's training are the places of toxic texts with byte sequences that recur in
toxic text and that ordinary text hardly has; the dictionary trainer keeps what many of these samples have in common.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, drawn_rows, fold, fresh, map_batches, per_process

#: The fit reads about so many labelled documents that are toxic, and twice as many that are not, whole: as many as
#: come to TRAIN_CHARS characters in all. This bounds the fit alone.
TRAIN_DOCS, TRAIN_CHARS = 2000, 48_000_000
#: Parts of the training rows for the calibration.
CALIBRATION_PARTS = 3
_OFFSETS = struct.pack("<3I", 1, 4, 8)


class Settings(NamedTuple):
    """Bytes of a window and of its overlap with the next, bytes of a gram, how many toxic texts a marked gram is in
    and in how many times their share of ordinary ones, bytes of the dictionaries."""

    window: int = 96
    overlap: int = 16
    gram: int = 4
    recur: int = 2
    contrast: int = 40
    toxic_bytes: int = 4 << 10
    ordinary_bytes: int = 64 << 10


SETTINGS = Settings()


def windows(text: bytes, settings: Settings = SETTINGS) -> list[bytes]:
    """Windows over the whole text; they overlap, so that no word is cut in all of them."""
    step = settings.window - settings.overlap
    return [text[i : i + settings.window] for i in range(0, max(1, len(text) - settings.overlap), step)]


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distance:
    """Difference of a window's compressed lengths without and with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.plain = self._compressor(zstandard.ZstdCompressionDict(ordinary, dict_type=raw))
        self.toxic = self._compressor(zstandard.ZstdCompressionDict(toxic + ordinary, dict_type=raw))

    @staticmethod
    def _compressor(dictionary):
        parameters = _parameters()
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def of(self, pieces: list[bytes]) -> np.ndarray:
        a, b = self.plain.compress, self.toxic.compress
        return np.array([len(a(p)) - len(b(p)) for p in pieces], dtype=np.float64)


def features(gaps: np.ndarray, threshold: float) -> list[float]:
    """What the logistic curve sees of a document: intercept, largest gap, windows over the threshold, their share."""
    hits = float((gaps >= threshold).sum())
    return [1.0, float(gaps.max()) if len(gaps) else 0.0, np.log1p(hits), hits / max(len(gaps), 1), np.log1p(max(0.0, float(gaps[gaps >= threshold].sum())))]


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _spans(text: bytes, marked: set[bytes], gram: int) -> list[bytes]:
    """The stretches of a text that marked grams cover."""
    out, start, last = [], None, 0
    for i in range(len(text) - gram + 1):
        if text[i : i + gram] in marked:
            if start is not None and i > last + gram:
                out.append(text[start : last + gram])
                start = None
            start, last = i if start is None else start, i
    if start is not None:
        out.append(text[start : last + gram])
    return out


def marked_grams(toxic: list[bytes], ordinary: list[bytes], settings: Settings = SETTINGS) -> set[bytes]:
    """Grams that recur in toxic texts and that ordinary ones hardly have."""
    size, n = settings.gram, {}
    for t in toxic:
        for g in {t[i : i + size] for i in range(len(t) - size + 1)}:
            n[g] = n.get(g, 0) + 1
    n = {g: k for g, k in n.items() if k >= settings.recur}
    seen = dict.fromkeys(n, 0)
    for t in ordinary:
        for g in {t[i : i + size] for i in range(len(t) - size + 1)}.intersection(seen):
            seen[g] += 1
    return {g for g, k in n.items() if k * len(ordinary) >= settings.contrast * (seen[g] + 0.5) * len(toxic)}


def probability(model: dict, gaps: np.ndarray) -> float:
    """The logistic curve at a document's gaps."""
    z = float(np.dot(features(gaps, model["threshold"]), model["weights"]))
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))


def dictionaries(toxic: list[bytes], ordinary: list[bytes], settings: Settings = SETTINGS) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    marked = marked_grams(toxic, ordinary, settings)
    plain = _dictionary([w for t in ordinary for w in windows(t, settings)], settings.ordinary_bytes)
    return plain, _dictionary([p for t in toxic for p in _spans(t, marked, settings.gram)], settings.toxic_bytes)


def fit(rows: list[tuple[int, str, int]], settings: Settings = SETTINGS) -> dict | None:
    """The model from (doc_id, text, toxic) rows; None if either class has fewer than four texts.

    The threshold and the curve are calibrated on differences that dictionaries of the other parts give each part of
    the rows (CALIBRATION_PARTS, dealt in the order of ids); the dictionaries that score are then built from all rows.
    """
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0], r[1]))
    by = {c: [r[1].encode("utf-8") for r in rows if r[2] == c] for c in (0, 1)}
    if min(map(len, by.values())) < 4:
        return None
    gaps: list[tuple[np.ndarray, int]] = []
    for part in range(CALIBRATION_PARTS):
        rest = {c: [t for i, t in enumerate(v) if i % CALIBRATION_PARTS != part] for c, v in by.items()}
        distance = Distance(*dictionaries(rest[1], rest[0], settings))
        gaps += [(distance.of(windows(t, settings)), c) for c in (0, 1) for t in by[c][part::CALIBRATION_PARTS]]
    y = np.array([c for _, c in gaps], dtype=float)
    best = None
    for threshold in (1, 2, 3, 4, 5, 6):
        x = np.array([features(g, threshold) for g, _ in gaps])
        w = logistic_fit(x, y)
        loss = _log_loss(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), y)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, threshold, w)
    ordinary, toxic = dictionaries(by[1], by[0], settings)
    return {"ordinary": ordinary, "toxic": toxic, "threshold": float(best[1]), "weights": best[2].tolist(), "settings": settings}


def cross_validated_loss(rows: list[tuple[int, str, int]], settings: Settings, folds: int = 3) -> float:
    """Log loss on each fold of a fit on the others, over rows that may be learned from.

    SETTINGS has the least sum of it over the training rows of two tables, among 36 settings drawn at random from a
    grid (window 48 to 256, overlap 16 or 32, gram 3 to 6, recur 2 to 8, contrast 5 to 80, dictionaries 2 to 110 KB).
    """
    total = n = 0.0
    for k in range(folds):
        inside = [r for r in rows if zlib.crc32(f"fold {r[0]}".encode()) % folds != k]
        rest = [r for r in rows if zlib.crc32(f"fold {r[0]}".encode()) % folds == k]
        model = fit(inside, settings)
        if model is None or not rest:
            return float("inf")
        distance = Distance(model["ordinary"], model["toxic"])
        p = np.array([probability(model, distance.of(windows((t or "").encode("utf-8"), settings))) for _, t, _ in rest])
        total += _log_loss(p, np.array([c for _, _, c in rest], dtype=float)) * len(rest)
        n += len(rest)
    return total / n


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; the samples' end where there are too few to train.

    What a trained dictionary has before its content (entropy tables, ended by three start offsets) is left out, as
    these tables do not serve windows of so few bytes.
    """
    try:
        whole = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]
    at = whole.find(_OFFSETS)
    return whole[at + len(_OFFSETS) :] if at >= 0 else whole


def held_out(doc_id="doc_id"):
    """Rows whose labels the fit never sees."""
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, usable=None) -> list[tuple[int, str, int]]:
    """The rows to fit on: those with the smallest hashes of the id in each class, whatever the partitions."""
    usable = ~held_out() if usable is None else usable
    return drawn_rows(docs, labels, usable, "toxic", {1: TRAIN_DOCS, 0: 2 * TRAIN_DOCS}, TRAIN_CHARS)


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score (probability that the text is toxic), windows and gap (the largest difference).

    Every window of every whole text is compressed twice. A null text counts as empty, which is one empty window.
    Without a model (too few labels) the score is 0. Rows are independent; repeated rows get equal scores. Kept columns
    of the new names are replaced.
    """
    keep = tuple(c for c in keep if c not in ("score", "windows", "gap"))
    chosen = docs.select(docs["text"].alias(fresh(docs, "body")[0]), *[docs[c] for c in keep])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about 70 KB

    def run(batches):
        m = sent.value
        distance = per_process(("toxicity", m["ordinary"], m["toxic"]), lambda: Distance(m["ordinary"], m["toxic"])) if m else None
        for b in by_size(batches, 0):
            scores, counts, largest = [], [], []
            for text in b.column(0).to_pylist():
                pieces = windows((text or "").encode("utf-8"), m["settings"] if m else SETTINGS)
                counts.append(len(pieces))
                if distance is None:
                    scores.append(0.0)
                    largest.append(0.0)
                    continue
                gaps = distance.of(pieces)
                scores.append(probability(m, gaps))
                largest.append(float(gaps.max()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(largest, pa.float64())], names=[*keep, "score", "windows", "gap"])

    return map_batches(chosen, run, f"{schema}, score double, windows long, gap double")
