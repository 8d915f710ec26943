"""Token counts by field and section, from one encoding of each whole document.

The fields of a document are put together, each followed by a line break, and encoded once. Every token
keeps the span of characters it covers; sections are intervals over the same characters. Both lists are
sorted, so the interval join within a document is one pair of binary searches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridspark.llm.byte_bpe import ByteBPE, read_bytes, shared_codec
from gridspark.llm.common import by_size, map_batches

RULES = ("most", "start", "end")


def count_batch(codec: ByteBPE, columns: list[pa.Array], by_line: list[bool], rule: str) -> dict[str, np.ndarray]:
    """Sections of a batch of documents (rows; columns: the fields' values) with their tokens, all rows at once."""
    columns = [c.cast(pa.string()).fill_null("") for c in columns]
    rows = len(columns[0])
    texts = pc.binary_join_element_wise(*columns, "", "\n")
    flat, token_ends = codec.encode_column(texts)
    data = np.frombuffer(b"".join(pc.cast(texts, pa.binary()).to_pylist()), dtype=np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text_ends = np.cumsum(sizes)
    text_starts = text_ends - sizes
    char_of = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) - 1  # the character of each byte

    ends = np.cumsum(codec.lengths[flat])
    first_char, last_char = char_of[ends - codec.lengths[flat]], char_of[ends - 1]
    breaks = np.flatnonzero(data == 10)
    kept = np.ones(len(breaks), dtype=bool)
    counts = np.ones((rows, len(columns)), dtype=np.int64)
    at = text_starts.copy()  # byte at which the field begins
    for k, column in enumerate(columns):
        inner = pc.count_substring(column, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        if by_line[k]:
            counts[:, k] += inner
        else:
            for row in np.flatnonzero(inner):  # line breaks within such a field end no section
                kept[(breaks >= at[row]) & (breaks < at[row] + size[row])] = False
        at += size + 1
    cuts = char_of[breaks[kept]] + 1 if len(breaks) else np.zeros(0, np.int32)

    where = np.searchsorted(cuts, first_char, side="right")
    if rule != "start":
        last = np.searchsorted(cuts, last_char, side="right")
        if rule == "end":
            where = last
        else:
            for i in np.flatnonzero(where != last):
                edges = np.concatenate(([first_char[i]], cuts[where[i] : last[i]], [last_char[i] + 1]))
                where[i] += int(np.argmax(np.diff(edges)))
    per_row = counts.sum(axis=1)
    row_of = np.repeat(np.arange(rows), per_row)
    base = char_of[text_starts] if len(data) else np.zeros(rows, np.int32)
    section_starts = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts
    fields = np.repeat(np.tile(np.arange(len(columns)), rows), counts.ravel())
    opening = np.cumsum(counts.ravel()) - counts.ravel()
    return {
        "row": row_of,
        "field": fields,
        "section": np.arange(len(row_of)) - np.repeat(opening, counts.ravel()),
        "start": section_starts - base[row_of],
        "end": cuts - base[row_of],
        "n_tokens": np.bincount(where, minlength=len(cuts)),
        "doc_tokens": np.diff(token_ends, prepend=0)[row_of],
    }


def attribute(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",), by_line: tuple[str, ...] = ("text",), rule: str = "most", id_col: str = "doc_id") -> DataFrame:
    """One row for each section of each document: id, field, section, start, end, n_tokens, doc_tokens.

    The counts of a document's sections add up to doc_tokens. Rows are independent (no shuffle): repeated ids
    give repeated rows, an empty table none; null or empty fields have one section, their line break.
    A token counts, under rule "most", where most of its characters are (the earlier section in a tie), under "start"
    where its first character is, under "end" where its last is. A line break belongs to the section before it.
    by_line names the fields that are cut into lines. Columns that are not named are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rank_file = docs.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))
    lines, kind = [f in by_line for f in fields], docs.schema[id_col].dataType.simpleString()

    b_column = 1 + max(range(len(fields)), key=lambda i: fields[i] == "text")

    def run(batches):
        codec = shared_codec(rank_file.value, pattern)
        for b in by_size(batches, b_column):
            found = count_batch(codec, [b.column(i + 1) for i in range(len(fields))], lines, rule)
            names = pa.array(fields, pa.string()).take(pa.array(found.pop("field")))
            taken = b.column(0).take(pa.array(found.pop("row")))
            yield pa.RecordBatch.from_arrays([taken, names, *(pa.array(x, pa.int64()) for x in found.values())], names=["id", "field", *found])

    chosen = docs.select(docs[id_col].alias("id"), *(docs[f].cast("string").alias(f"field{i}") for i, f in enumerate(fields)))
    return map_batches(chosen, run, f"id {kind}, field string, section long, start long, end long, n_tokens long, doc_tokens long")
