"""Splitting oversized texts at natural boundaries, with overlap.

Method: recursive bisection. A text above the limit is cut at the strongest boundary near its
midpoint, and again while a half exceeds the limit minus overlap; then every piece but the first is
extended to the left by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import RANKS, encoding

#: Boundaries, strongest first; a cut falls at the end of the match.
BOUNDARIES = (
    (4, re.compile(rb"\n(?=[ \t]*(?:#{1,6} |={3,}|-{3,}|\d+(?:\.\d+)*[.)] ))")),
    (3, re.compile(rb"\n[ \t]*\r?\n\s*|\r[ \t]*\r")),
    (2, re.compile(rb"\r?\n|\r")),
    (1, re.compile(rb"[.!?][\"')\]]*\s+")),
)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all natural boundaries, sorted, and the strength of each (the strongest where kinds meet)."""
    found: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(data):
            found.setdefault(m.end(), strength)
    at = np.array(sorted(found), np.int64)
    return at, np.array([found[p] for p in at.tolist()], np.int8)


def cut_points(data: bytes, ends: np.ndarray, limit: int, room: int) -> list[int]:
    """Where to cut: byte positions, so that the first piece has at most ``limit`` tokens and others ``room``.

    ``ends`` are the byte positions at which tokens end. A cut is sought in the middle half (by tokens)
    of what is to be halved; where no boundary lies there, at the token end nearest the midpoint that
    ends a character.
    """
    at, strength = boundaries(data)
    tokens_at = np.searchsorted(ends, at)  # tokens wholly or partly before a boundary
    whole = np.frombuffer(data + b"a", np.uint8)
    starts_char = (whole & 0xC0) != 0x80
    cuts: list[int] = []
    todo = [(0, 0, len(data), len(ends))]  # bytes and tokens, from and to
    while todo:
        b0, t0, b1, t1 = todo.pop()
        if t1 - t0 <= (limit if b0 == 0 else room) or b1 - b0 < 2:
            continue
        mid, quarter = (t0 + t1) / 2, (t1 - t0) / 4
        lo, hi = np.searchsorted(tokens_at, [mid - quarter, mid + quarter])
        near = np.arange(lo, hi)
        near = near[(at[near] > b0) & (at[near] < b1)]
        if len(near):
            near = near[strength[near] == strength[near].max()]
            k = near[np.argmin(np.abs(tokens_at[near] - mid))]
            cut = int(at[k])
        else:
            own = ends[t0:t1]
            own = own[(own > b0) & (own < b1)]
            own = own[starts_char[own]]
            if len(own):
                cut = int(own[np.argmin(np.abs(np.searchsorted(ends, own) - mid))])
            else:
                inner = np.flatnonzero(starts_char[b0 + 1 : b1]) + b0 + 1
                if not len(inner):
                    continue
                cut = int(inner[len(inner) // 2])
        t = int(np.searchsorted(ends, cut))
        cuts.append(cut)
        todo += [(b0, t0, cut, t), (cut, t, b1, t1)]
    return sorted(cuts)


def pieces(text: str, enc, limit: int = 768, overlap: int = 64, ids: list[int] | None = None) -> list[tuple[int, int, int, str, int, int]]:
    """``(piece_no, start, end, piece, n_tokens, n_overlap)`` of a text; offsets are characters, ``start`` the first after the overlap.

    ``ids`` are the text's tokens, if they are known. Tokens next to a cut may merge differently than in the whole text, so each piece is counted again
    by itself; one above the limit gives up overlap, and is halved again if that does not do.
    """
    data = text.encode("utf-8")
    ids = enc.encode_ordinary(text) if ids is None else ids
    sizes = np.fromiter((len(enc.decode_single_token_bytes(i)) for i in ids), np.int64, len(ids))
    ends = np.cumsum(sizes)
    whole = np.frombuffer(data + b"a", np.uint8)
    starts_char = (whole & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(starts_char[: len(data)])]
    marks = [0, *cut_points(data, ends, limit, limit - overlap), len(data)]
    spans = list(zip(marks, marks[1:]))[::-1]
    out = []
    while spans:
        b0, b1 = spans.pop()
        first = int(np.searchsorted(ends, b0))
        back = overlap if b0 else 0
        while True:
            lead = b0 if not back else int(ends[first - back - 1]) if first - back > 0 else 0
            while not starts_char[lead]:
                lead += 1
            lead = min(lead, b0)
            piece = data[lead:b1].decode("utf-8")
            n = len(enc.encode_ordinary(piece))
            if n <= limit or not back:
                break
            back = max(0, back - max(1, n - limit))
        inner = np.flatnonzero(starts_char[b0 + 1 : b1]) + b0 + 1 if n > limit else ()
        if len(inner):
            half = int(inner[len(inner) // 2])
            spans += [(half, b1), (b0, half)]
            continue
        out.append((len(out), int(chars[b0]), int(chars[b1]), piece, n, int(chars[b0] - chars[lead])))
    return out


def chunk(docs: DataFrame, id_col: str, text_col: str, limit: int = 768, overlap: int = 64, ranks_path: str = RANKS) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    ``doc_id, piece_no`` (from 0), ``start, end`` (characters of the text this piece adds),
    ``piece`` (its text with the overlap before it), ``n_tokens`` (``limit`` at most), ``overlap_chars``.
    Texts within the limit, empty and null texts give no row. Text is never changed: the spans
    ``start..end`` of a text join up to all of it. Each text is cut in one pass where it lies; no shuffle.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).filter(F.length("__text") > 0)
    kind = src.schema["doc_id"].dataType.simpleString()
    # a token is one byte at least, so shorter texts cannot exceed the limit
    src = src.filter(F.octet_length("__text") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path)
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["__text"]):
                ids = enc.encode_ordinary(text)
                if len(ids) > limit:
                    rows += [(i, *p) for p in pieces(text, enc, limit, overlap, ids)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start", "end", "piece", "n_tokens", "overlap_chars"])

    return src.mapInPandas(run, f"doc_id {kind}, piece_no int, start bigint, end bigint, piece string, n_tokens int, overlap_chars int")
