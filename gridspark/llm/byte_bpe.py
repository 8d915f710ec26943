"""Byte-level BPE: linear-time encoding by backtracking over Aho-Corasick matches, and decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours, merged from
their bytes alone, come out as themselves. So the encoder walks a piece from left to right, takes the
longest token that is compatible with the one before, and steps back to a shorter one where it gets
stuck. The encoding of a prefix is unique, hence a position found dead once is dead for good, and the
walk is linear in the bytes of the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from gridspark.llm.common import by_size, gather, map_batches, per_process

#: A run of white space and the run after it. Every match of the split pattern stays within one of these.
CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: White space of other kinds; texts with any of it are split as a whole.
OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
CACHE_CHUNKS, CACHE_PIECES, CACHE_PAIRS = 350_000, 100_000, 400_000
#: With this split pattern, such a part is one word (with the space before it) and one mark.
WORD_PATTERN = public_tokenizers.PATTERN
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


class LibraryClasses:
    """Whether the tiktoken library's Unicode tables hold a code point for a letter, a number or neither.

    Its tables are older than those of the regex module. A probe vocabulary merges the last byte of the
    code point with a following letter or digit only if both are in one match of the split pattern.
    """

    def __init__(self, pattern: str):
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)}
        for last in range(0x80, 0xC0):
            for mark in b"a1":
                ranks[bytes([last, mark])] = len(ranks)
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def stand_in(self, char: str) -> str:
        """A common character of the same class."""
        for mark in "a1":
            if len(self.probe.encode_ordinary(char + mark)) == len((char + mark).encode("utf-8")) - 1:
                return mark
        return "!"


class ByteBPE:
    """Encoder and decoder for a rank file (one line for each token: base64, space, rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.by_id = [self.tokens.get(i, b"") for i in range(self.size)]
        self._sizes = [len(t) for t in self.by_id]
        self.lengths = np.array(self._sizes, dtype=np.int64)
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) == 1 or self._merged(token) == [rank]:  # others come up only as whole pieces
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self.pattern, self._classes = pattern, None

    def _merged(self, data: bytes) -> list[int]:
        """Lowest-rank merges, straight from the definition; for strings of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [(ranks[joined], i) for i in range(len(parts) - 1) if (joined := parts[i] + parts[i + 1]) in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._merged(self.by_id[left] + self.by_id[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        string = piece.decode("latin-1")
        longest = [token for _, token in self.automaton.iter_long(string)]  # right as it is, if it covers all and fits
        if sum(map(self._sizes.__getitem__, longest)) == n and all(map(self.compatible, longest, longest[1:])):
            return longest
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        sizes = self._sizes
        for last, token in self.automaton.iter(string):
            starting[last + 1 - sizes[token]].append(token)  # shorter ones come first
        alive = bytearray(b"\x01") * (n + 1)
        path: list[int] = []
        choices: list[int] = []
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            options = starting[at]
            while choice >= 0:
                token = options[choice]
                end = at + sizes[token]
                if alive[end] and (not path or self.compatible(path[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                path.append(token)
                choices.append(choice)
                at = end
                choice = len(starting[at]) - 1
            else:
                alive[at] = 0
                if not path:
                    raise ValueError("the rank file lacks a byte of the piece")
                at -= sizes[path.pop()]
                choice = choices.pop() - 1
        return path

    def pieces(self, span: str) -> list[str]:
        """Matches of the split pattern, under the library's Unicode tables."""
        if BEYOND_LATIN.search(span) and any(unicodedata.category(c) == "Cn" for c in span):
            self._classes = self._classes or LibraryClasses(self.pattern)
            shape = "".join(self._classes.stand_in(c) if unicodedata.category(c) == "Cn" else c for c in span)
            return [span[m.start() : m.end()] for m in self.split.finditer(shape)]
        return self.split.findall(span)

    def _encode_span(self, span: str) -> bytes:
        out = []
        cache = self._pieces
        for piece in self.pieces(span):
            known = cache.get(piece)
            if known is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                known = struct.pack(f"<{len(ids)}I", *ids)  # bytes, which the garbage collector does not walk
                if len(piece) <= 32:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; b"" for an empty text.

        Only WORD_PATTERN is known to end its matches where chunks end; other patterns go over whole texts.
        """
        if self.pattern != WORD_PATTERN or OTHER_SPACE.search(text):
            return self._encode_span(text)
        cache = self._chunks
        chunks = CHUNK.findall(text)
        out = list(map(cache.get, chunks))
        if None in out:
            if len(cache) >= CACHE_CHUNKS:
                cache.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    chunk = chunks[i]
                    ids = cache.get(chunk)
                    if ids is None:
                        ids = self._encode_span(chunk)
                        if len(chunk) <= 64:
                            cache[chunk] = ids
                    out[i] = ids
        return b"".join(out)

    def _look_up(self, keys: list[str], cache: dict[str, bytes], fresh) -> list[bytes]:
        out = list(map(cache.get, keys))
        if None in out:
            if len(cache) + len(keys) > CACHE_CHUNKS:
                cache.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = ids = fresh(keys[i])
                    if len(keys[i]) <= 64:
                        cache[keys[i]] = ids
        return out

    def _encode_word(self, word: str) -> bytes:
        ids = self.encode_piece((" " + word).encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end; the same ids as encode()'s.

        Texts are cut before each space, which is where a match ends unless white space stands before the
        space; a text with such a place is encoded by itself. A part of Latin-1 letters and at most a full stop
        or comma is two matches. Each different part is taken apart once, each different word is looked up once.
        """
        texts = texts.fill_null("")
        if self.pattern != WORD_PATTERN:
            ids = [self.encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
        split = pc.split_pattern(texts, " ")
        parts = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(parts.dictionary, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        kept = parts.dictionary.filter(plain)
        mark = pc.ends_with(kept, ".").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * pc.ends_with(kept, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.utf8_rtrim(kept, characters=".,").dictionary_encode()
        rest = parts.dictionary.filter(pc.invert(plain)).to_pylist()

        values = [b"", self._encode_span("."), self._encode_span(",")]
        first = len(values)
        values += self._look_up(words.dictionary.to_pylist(), self._words, self._encode_word)
        others = len(values)
        values += self._look_up(rest, self._parts, lambda part: self._encode_span(" " + part))
        body, tail = np.zeros(len(is_plain), np.int64), np.zeros(len(is_plain), np.int64)
        body[is_plain] = first + words.indices.to_numpy()
        body[~is_plain] = others + np.arange(len(rest))
        tail[is_plain] = mark
        unsafe = np.zeros(len(is_plain), bool)
        unsafe[~is_plain] = [not k or k[-1] in " \t\n\r\f\v" or OTHER_SPACE.search(k) is not None for k in rest]

        at = parts.indices.to_numpy()
        index = np.stack((body[at], tail[at]), axis=1)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        doubtful = unsafe[at]
        doubtful[ends - 1] = False  # white space at the end of a text cuts nothing off
        whole = np.add.reduceat(doubtful, starts) > 0 if len(ends) else np.zeros(0, bool)
        openings = parts.dictionary.take(pa.array(at[starts])).to_pylist() if len(ends) else []
        for row, k in enumerate(starts.tolist()):  # the first part has no space before it
            if whole[row]:
                values.append(self.encode(texts[row].as_py()))
                index[k : ends[row]] = 0
            else:
                values.append(self._encode_span(openings[row]))
            index[k] = (len(values) - 1, 0)
        flat, part_ends = gather(index.ravel(), values, "<u4")
        return flat, part_ends[2 * ends - 1] if len(ends) else ends

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def shared_codec(rank_file: bytes, pattern: str) -> ByteBPE:
    return per_process(("byte_bpe", hashlib.sha256(rank_file).digest(), pattern), lambda: ByteBPE(rank_file, pattern))


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text: id, ids (binary, little-endian uint32), n_tokens, decoded (binary).

    The rank file is read on the driver (its size is that of a vocabulary) and sent to the workers.
    Rows are independent: no shuffle, duplicates and ties are kept as they come. A null or empty text has no ids.
    Other columns of docs are not carried.
    """
    rank_file = docs.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = shared_codec(rank_file.value, pattern)
        for b in by_size(batches, 1):
            flat, ends = codec.encode_column(b.column(1))
            raw, cuts = flat.tobytes(), [0, *(ends * 4).tolist()]
            ids = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([codec.decode(x) for x in ids], pa.binary())],
                names=["id", "ids", "n_tokens", "decoded"],
            )

    return map_batches(docs.select(docs[id_col].alias("id"), docs[text].alias("text")), run, f"id {kind}, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s ids and decoded bytes."""
    from pyspark.sql import functions as F

    return encode(docs, ranks_path, pattern).select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
