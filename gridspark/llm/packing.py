"""Mixture-controlled packing by deficit round-robin over one token queue for each source.

Round-robin with deficits gives every source its quantum in every window and carries what is left over
to the next. As documents may be cut at any token, a queue's deficit after w windows is less than one
token, and the round-robin's state has a closed form: the queues up to and including queue j have sent
floor(C_j(w x window)) tokens, where C_j is their fluid share of the first t tokens. No task has to run
through the windows one after another: from a document's position in its queue follow its windows, places
and cuts. All that crosses partitions is the sum of tokens for each partition and queue.

Steps: (1) encode and store ids, with each document's position in its partition's part of the queue;
(2) sums for each (partition, queue) give every part's base; (3) cut.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.byte_bpe import read_bytes
from gridspark.llm.common import binary_column, by_size, gather, map_batches, per_process, stash

#: Tokens in a window: 16 sequences, so that most documents of a small source stay in one piece.
WINDOW = 16 * 4096
#: Buckets of a queue's (source, part) rows.
BUCKETS = 256
#: Base rows up to this number are broadcast (40 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
CACHE_RUNS, CACHE_WORDS, AT_ONCE = 100_000, 400_000, 2_000
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def check_form(definition: bytes) -> None:
    """ValueError for a tokenizer of another form than the one that CachedTokenizer's caches are right for."""
    form = json.loads(definition)
    kinds = lambda part, name: [x["type"] for x in ((form.get(part) or {}).get(name) or [])]
    if (kinds("normalizer", "normalizers"), kinds("pre_tokenizer", "pretokenizers"), form["model"].get("end_of_word_suffix")) != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "</w>"):
        raise ValueError("the tokenizer must lower case, drop white space, split words from marks and end words in </w>")


class CachedTokenizer:
    """A tokenizer that lowers case and drops white space, with caches of the ids of runs of other characters.

    No token of it spans white space (ASCII), so a text's ids are those of its runs, one after another. A run of
    Latin-1 letters and at most a full stop or comma is a lower-case word and that mark, as the tokenizer's own
    split has it; new words go to the tokenizer many at a time, and come apart at the tokens that end words.
    """

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        check_form(definition)
        self.tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._runs: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._marks = [self._alone(mark) for mark in ".,"]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _fresh(self, words: list[str]) -> list[bytes]:
        """Ids of each of some lower-case words of letters: each is one word to the tokenizer, up to a token that ends words."""
        out = []
        for k in range(0, len(words), AT_ONCE):  # the tokenizer takes some kilobytes of memory for each word of a text
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words[k : k + AT_ONCE])], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = ((np.flatnonzero(self.final[ids]) + 1) * ids.itemsize).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _look_up(self, keys: list[str], cache: dict[str, bytes], most: int, fresh) -> list[bytes]:
        out = list(map(cache.get, keys))
        if None in out:
            missing = [key for key, ids in zip(keys, out) if ids is None]
            found = fresh(missing)
            if len(cache) + len(missing) > most:
                cache.clear()
            cache.update((key, ids) for key, ids in zip(missing, found) if len(key) <= 64)
            rest = iter(found)
            out = [next(rest) if ids is None else ids for ids in out]
        return out

    def encode(self, texts: pa.StringArray, after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the ids `after`, and where each text's end.

        Each different run of a batch is taken apart once, each different word is looked up once.
        """
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        runs = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(runs.dictionary, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        lowered = pc.utf8_lower(runs.dictionary.filter(plain))
        mark = pc.ends_with(lowered, ".").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * pc.ends_with(lowered, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.utf8_rtrim(lowered, characters=".,").dictionary_encode()
        values = [b"", *self._marks, after]
        marks, end, first = 1, len(values) - 1, len(values)
        values += self._look_up(words.dictionary.to_pylist(), self._words, CACHE_WORDS, self._fresh)
        others = len(values)
        rest = runs.dictionary.filter(pc.invert(plain)).to_pylist()
        values += self._look_up(rest, self._runs, CACHE_RUNS, lambda found: list(map(self._alone, found)))

        body, tail = np.zeros(len(is_plain), np.int64), np.zeros(len(is_plain), np.int64)
        body[is_plain] = first + words.indices.to_numpy()
        body[~is_plain] = others + np.arange(len(rest))
        tail[is_plain] = np.where(mark > 0, marks + mark - 1, 0)
        at = runs.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        index = np.insert(np.stack((body[at], tail[at]), axis=1).ravel(), 2 * ends, end)
        flat, run_ends = gather(index, values, self.dtype)
        return flat, run_ends[2 * ends + np.arange(len(ends))]


def schedule(totals: list[int], weights: list[float] | None = None) -> list[tuple[int, list[int]]]:
    """Break points (t, tokens of queues 0..j among the first t, for each j) of the fluid round-robin.

    Without weights, shares are those of the corpus and all queues end together. With weights, queues send in
    those proportions until one is empty; then the others go on in theirs.
    """
    n, left = len(totals), list(totals)
    share = [float(t) for t in totals] if weights is None else [float(w) for w in weights]
    points, t, sent = [(0, [0] * n)], 0, [0] * n
    while any(left):
        active = [j for j in range(n) if left[j]]
        if weights is None or not sum(share[j] for j in active):
            step = {j: left[j] for j in active}
        else:
            total = sum(share[j] for j in active)
            ends = min((left[j] * total / share[j] for j in active if share[j]))
            step = {j: min(left[j], round(ends * share[j] / total)) for j in active}
            first = min((j for j in active if share[j]), key=lambda j: left[j] / share[j])
            step[first] = left[first]
        for j, k in step.items():
            sent[j] += k
            left[j] -= k
        t += sum(step.values())
        points.append((t, np.cumsum(sent).tolist()))
    return points


class RoundRobin:
    """Where the tokens of each queue go."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int, length: int):
        self.points = schedule(totals, weights)
        self.times = [t for t, _ in self.points]
        self.total, self.window, self.length = sum(totals), window, length
        self.windows = -(-self.total // window)
        rest = self.total % length
        self.tail_start = self.total - rest
        self.tail = []  # the last tokens go to sequences of powers of two, which need no padding
        for bit in reversed(range(length.bit_length())):
            if rest >> bit & 1:
                self.tail.append(1 << bit)

    def upto(self, j: int, w: int) -> int:
        """Tokens that queues 0..j have sent after w windows."""
        if j < 0:
            return 0
        t = min(w * self.window, self.total)
        k = max(1, bisect.bisect_left(self.times, t))
        if k >= len(self.points):
            return self.points[-1][1][j]
        (t0, a), (t1, b) = self.points[k - 1], self.points[k]
        return a[j] + (b[j] - a[j]) * (t - t0) // (t1 - t0)

    def sent(self, j: int, w: int) -> int:
        return self.upto(j, w) - self.upto(j - 1, w)

    def window_of(self, j: int, x: int) -> int:
        """The window that sends token x of queue j."""
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high) // 2
            if self.sent(j, mid + 1) > x:
                high = mid
            else:
                low = mid + 1
        return low

    def place(self, at: int) -> tuple[int, int, int]:
        """Sequence, offset there and tokens up to its end, of a place in the whole output."""
        if at < self.tail_start:
            return at // self.length, at % self.length, self.length - at % self.length
        at -= self.tail_start
        sequence = self.tail_start // self.length
        for n in self.tail:
            if at < n:
                return sequence, at, n - at
            at -= n
            sequence += 1
        raise IndexError(at)

    def pieces(self, j: int, x: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) for the document at [x, x+n) of queue j."""
        out, done = [], 0
        w = self.window_of(j, x)
        while done < n:
            begin, end = self.sent(j, w), self.sent(j, w + 1)
            # a window holds the queues' shares in order
            at = w * self.window + (self.upto(j - 1, w + 1) - self.upto(j - 1, w)) + (x + done - begin)
            k = min(n - done, end - (x + done))
            while k > 0:
                sequence, offset, room = self.place(at)
                take = min(k, room)
                out.append((done, take, sequence, offset))
                done, at, k = done + take, at + take, k - take
            w += 1
        return out


def queues(totals: dict[str | None, int], weights: dict[str, float] | None, window: int) -> tuple[dict[str | None, int], list[int], list[float] | None]:
    """Queue of each source, tokens of each queue, weight of each queue. None: all sources that are not named.

    A source with less than two tokens a window would make the rounding run backwards; such sources share a queue.
    Sources without a weight share one that sends when the others are empty.
    """
    total, order = sum(totals.values()), sorted(s for s in totals if s is not None) + [None] * (None in totals)
    share = {s: totals[s] / total if total else 1.0 for s in order}
    if weights is not None:
        given = sum(weights.get(s, 0.0) for s in order) or 1.0
        share = {s: weights.get(s, 0.0) / given for s in order}
    idle = [s for s in order if not share[s]]
    small = [s for s in order if share[s] and (s is None or min(share[s], totals[s] / total) * window < 2)] if total > window else []
    large = [s for s in order if s not in {*small, *idle}]
    if small and large and sum(share[s] for s in small) * window < 2:
        small.append(large.pop(min(range(len(large)), key=lambda i: totals[large[i]])))
    groups = [[s] for s in large] + [g for g in (small, idle) if g]
    number = {s: k for k, g in enumerate(groups) for s in g}
    return number, [sum(totals[s] for s in g) for g in groups], None if weights is None else [sum(share[s] for s in g) for g in groups]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, window: int = WINDOW, weights: dict[str, float] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pack all documents; a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    weights: target token proportions of the sources (null is the source ""); by default those of the corpus, with
    which every window is filled to target up to the end. Sources of less than two tokens a window share a queue, in which
    one follows another. With weights, sources that have none come last. A null or empty text is the end id alone. Repeated ids
    are packed as often as they come. An empty table gives no rows. Columns that are not named are not read.
    """
    spark = docs.sparkSession
    check_form(definition_bytes := read_bytes(tokenizer_path))
    definition = spark.sparkContext.broadcast(definition_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    cores = {"tokenizer": lambda d: per_process(("words", hashlib.sha256(d).digest()), lambda: CachedTokenizer(d))}

    def tokenize(batches):
        tokenizer = cores["tokenizer"](definition.value)
        end = np.array([end_id], dtype=tokenizer.dtype).tobytes()
        sent: dict[str, int] = {}
        for b in by_size(batches, 1, 4 << 20):
            flat, ends = tokenizer.encode(b.column(1), end)
            sizes = np.diff(ends, prepend=0)
            places = []
            for s, n in zip(b.column(2).to_pylist(), sizes.tolist()):
                places.append(sent.get(s, 0))
                sent[s] = places[-1] + n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), binary_column(flat, ends)], names=["id", "source", "part", "place", "n", "ids"])

    chosen = docs.select(docs[id_col].alias("id"), docs[text].alias("text"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"), F.spark_partition_id().alias("part"))
    tokens = stash(map_batches(chosen, tokenize, f"id {kind}, source string, part int, place long, n long, ids binary"), "tokens")

    sums = stash(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    # sources with two tokens a window or more, of which there are window / 2 at most, or those that have a weight
    total = sums.agg(F.sum("n")).first()[0] or 0
    of_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    named = of_source.where(F.col("n") * F.lit(window) >= F.lit(2 * total)) if weights is None else of_source.where(F.col("source").isin(*weights))
    totals_by: dict[str | None, int] = {r["source"]: r["n"] for r in named.collect()}
    if total > sum(totals_by.values()):
        totals_by[None] = total - sum(totals_by.values())
    number, totals, shares = queues(totals_by, weights, window)
    plan = RoundRobin(totals, shares, window, length) if totals else None

    names = spark.createDataFrame([(s, k) for s, k in number.items() if s is not None], "source string, queue int")
    dealt = sums.join(F.broadcast(names), "source", "left").select("part", "source", "n", F.coalesce("queue", F.lit(number.get(None, 0))).alias("queue"), F.pmod(F.xxhash64("source", "part"), F.lit(BUCKETS)).alias("bucket"))
    # running sums within a bucket and over a queue's buckets, so that no task has all parts of a queue
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    opening = dealt.groupBy("queue", "bucket").agg(F.sum("n").alias("n")).select("queue", "bucket", F.coalesce(F.sum("n").over(before("queue").orderBy("bucket")), F.lit(0)).alias("opening"))
    within = dealt.select("*", F.coalesce(F.sum("n").over(before("queue", "bucket").orderBy("source", "part")), F.lit(0)).alias("within"))
    base = within.join(opening, ["queue", "bucket"]).select("part", "source", "queue", (F.col("opening") + F.col("within")).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, ["part", "source"]).select("id", "source", "queue", (F.col("base") + F.col("place")).alias("at"), "n", "ids")

    def cut(batches):
        dtype = cores["tokenizer"](definition.value).dtype
        for b in batches:
            rows, out = [], [[] for _ in range(6)]
            queue, at, n = (b.column(i).to_pylist() for i in (2, 3, 4))
            for i, raw in enumerate(b.column(5).to_pylist()):
                ids = np.frombuffer(raw, dtype=dtype).astype("<u4")
                for start, size, sequence, offset in plan.pieces(queue[i], at[i], n[i]):
                    rows.append(i)
                    for column, value in zip(out, (start, size, zlib.crc32(ids[start : start + size].tobytes()), n[i], sequence, offset)):
                        column.append(value)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), *(pa.array(x, pa.int64()) for x in out), b.column(1).take(taken)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return map_batches(placed, cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
