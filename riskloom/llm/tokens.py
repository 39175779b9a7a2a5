"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once. Token ids give byte lengths, and their running sum the span
of every token, which is joined to the sections' spans as sorted intervals. A token that
crosses a boundary goes to the section that holds most of its bytes, of equal ones to the
first; so each token counts once and a document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

# How the rank file's vocabulary cuts text before its merges; fixed by that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# White space as that pattern sees it, and the length from which a run is encoded by itself.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = 5_000
COUNTED = T.ArrayType(
    T.StructType().add("section", "integer").add("start", "long").add("end", "long").add("tokens", "long").add("crossing", "long")
)


def ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def encoded(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The token ids of ``text``, with long runs of white space encoded on their own.

    The pattern looks ahead from white space only, which is what long runs overflow. It
    takes a run of n but for its last character, or whole at the end of the text, as one
    piece, whatever stands before. Other pieces end where white space begins. So the text up
    to the run, that piece, and the rest from the run's last character give the same tokens.
    """
    parts, at = [], 0
    for run in re.finditer(f"[{BLANK}]{{{LONG_BLANK},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        parts.append(np.array(encoding._encode_single_piece(text[run.start() : end]), np.int64))
        at = end
    parts.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts).astype(np.int64)


def section_ends(raw: bytes, boundary: bytes) -> np.ndarray:
    """Where sections end, in bytes: behind each match of ``boundary`` and at the end of the text."""
    ends = [m.end() for m in re.finditer(boundary, raw) if m.end() > m.start()]
    return np.array(ends if ends and ends[-1] == len(raw) else [*ends, len(raw)], np.int64)


def attribute(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each section the tokens that it gets, and how many of those cross a boundary.

    ``lengths`` are the tokens' sizes and ``ends`` the sections' ends, which cover the
    same text without gaps.
    """
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop, "left")
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for t in crossing.tolist():
        inner = np.concatenate([[start[t]], ends[first[t] : last[t]], [stop[t]]])
        owner[t] = first[t] + int(np.argmax(np.diff(inner)))
    n = len(ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, sections: str = "sections", boundary: bytes = rb"\n") -> DataFrame:
    """``docs`` with an array ``sections``: for each its number, span in code points (end
    exclusive), tokens, and how many of them cross its border. A section ends behind each
    match of ``boundary``, a pattern on UTF-8 bytes; by default, sections are lines.

    The vocabulary is read where the query is built and sent to the tasks. Null and empty
    texts have no sections; texts of any length are encoded whole. Every other column stays; one named ``sections`` is replaced.
    Rows are counted one by one, so repeated rows agree and an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != sections]
    shared = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    schema = docs.select(*kept).schema.add(sections, COUNTED)
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        size = np.zeros(max(shared.value.values()) + 1, np.int64)
        for token, rank in shared.value.items():
            size[rank] = len(token)
        for batch in batches:
            offsets, columns = [0], [[], [], [], [], []]
            for value in batch.column(at):
                text = value.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                if raw:
                    ends = section_ends(raw, boundary)
                    tokens, crossing = attribute(size[encoded(encoding, text)], ends)
                    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    stop = points[ends - 1]
                    parts = (np.arange(len(ends)), np.concatenate([[0], stop[:-1]]), stop, tokens, crossing)
                    for column, part in zip(columns, parts):
                        column.append(part)
                    offsets.append(offsets[-1] + len(ends))
                else:
                    offsets.append(offsets[-1])
            whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
            fields = [pa.array(whole[0].astype(np.int32), pa.int32()), *(pa.array(c.astype(np.int64), pa.int64()) for c in whole[1:])]
            items = pa.StructArray.from_arrays(fields, ["section", "start", "end", "tokens", "crossing"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], [*kept, sections]
            )

    return docs.select(*kept).mapInArrow(run, schema)
