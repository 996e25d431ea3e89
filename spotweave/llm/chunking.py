"""Pieces of bounded size, cut where the content says so and snapped to natural boundaries."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.tokens import VOCABULARY, encode, encoding

WINDOW = 16
LANDMARK_BITS = 8
SNAP = 64
PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1


@functools.lru_cache(maxsize=2)
def _tables(path: str):
    """Byte length and a 64-bit random value of each token, from the vocabulary alone."""
    tokens = encoding(path).token_byte_values()
    lengths = np.zeros(encoding(path).n_vocab, dtype=np.int64)
    for token in tokens:
        lengths[encoding(path).encode_single_token(token)] = len(token)
    return lengths, np.random.default_rng(7).integers(0, 2**64, len(lengths), dtype=np.uint64)


def _boundaries(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """The natural boundary each token ends at: 0 none, then WORD, SENTENCE, LINE, PARAGRAPH.

    A cut lies between a visible character and the white space after it, where the tokenizer splits whatever
    surrounds it: the texts on both sides have the same tokens alone as together.
    """
    b = np.frombuffer(raw + b"\n\n\n", dtype=np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    before, after = b[ends - 1], b[ends]
    # Unicode's other spaces end in these bytes; a cut behind one of them is not taken.
    wide = (before >= 0x80) & (((before == 0xA0) | (before == 0x85) | (before == 0x80) | (before == 0x9F) | (before == 0xAF) | (before == 0xA8) | (before == 0xA9) | ((before > 0x80) & (before <= 0x8A))))
    level = (~white[ends - 1] & ~wide & white[ends]).astype(np.int8)
    stop = (before == 46) | (before == 33) | (before == 63)
    level[(level > 0) & stop] = SENTENCE
    newline = (level > 0) & ((after == 10) | (after == 13))
    level[newline] = LINE
    second = np.where((after == 13) & (b[ends + 1] == 10), b[np.minimum(ends + 2, len(b) - 1)], b[ends + 1])
    level[newline & ((second == 10) | (second == 13))] = PARAGRAPH
    return level


#: Marks that end something without white space behind them.
MARKS = {"。": SENTENCE, "！": SENTENCE, "？": SENTENCE, "、": WORD, "，": WORD, ">": WORD, "&nbsp;": WORD}


def _marks(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """SENTENCE or WORD where a token ends behind one of MARKS, 0 elsewhere; for use where no white space is in reach."""
    b = np.concatenate((np.zeros(6, dtype=np.uint8), np.frombuffer(raw, dtype=np.uint8)))
    level = np.zeros(len(ends), dtype=np.int8)
    for mark, worth in MARKS.items():
        m = mark.encode()
        level[np.all([b[ends + 6 - len(m) + k] == x for k, x in enumerate(m)], axis=0)] = worth
    return level


class Cutter:
    """Cuts of one text's tokens.

    A rolling hash of the last WINDOW tokens marks landmarks. Of the positions between ``least`` new tokens and the room that the overlap
    leaves, the first landmark is taken (without one, that with the smallest hash) and moved to the best natural boundary within SNAP
    tokens, the nearer of equals; without any there, to the best one in reach, and without white space in reach likewise to MARKS. A cut is preferred whose overlap begins at a word, too.
    Landmarks depend on nearby tokens alone, so an edit moves the cuts around it and the later ones fall in step again.
    """

    def __init__(self, tokens: np.ndarray, raw: bytes, lengths: np.ndarray, gear: np.ndarray, limit: int, overlap: int, least: int):
        n = len(tokens)
        self.limit, self.overlap, self.least = limit, overlap, least
        self.at = np.concatenate(([0], np.cumsum(lengths[tokens])))
        self.level = _boundaries(raw, self.at[1:])
        self.mark = _marks(raw, self.at[1:])
        self.aligned = (np.frombuffer(raw + b" ", dtype=np.uint8)[self.at[1:]] & 0xC0) != 0x80
        value, h = gear[tokens], np.zeros(n, dtype=np.uint64)
        for k in range(min(WINDOW, n)):
            h[k:] += value[: n - k] << np.uint64(k)
        self.hash = h >> np.uint64(24)
        self.landmarks = np.flatnonzero((self.hash & np.uint64(2**LANDMARK_BITS - 1)) == 0)
        word = self.level > 0
        smooth = np.zeros(n, dtype=bool)
        smooth[overlap:] = word[: n - overlap] if overlap else True
        self.score = self.level + 2 * (smooth & word)

    def after(self, start: int) -> int:
        """Where the piece whose new tokens begin at ``start`` ends."""
        n, room = len(self.level), self.limit - min(start, self.overlap)
        if n - start <= room:
            return n
        low, high = start + self.least - 1, start + room  # the last token i of the piece: low <= i < high
        k = np.searchsorted(self.landmarks, low)
        at = int(self.landmarks[k]) if k < len(self.landmarks) and self.landmarks[k] < high else low + int(self.hash[low:high].argmin())
        for level in (self.score, self.mark):
            for a, z, worth in ((max(low, at - SNAP), min(high, at + SNAP + 1), SENTENCE), (low, high, WORD)):
                score = level[a:z]
                if (best := score.max()) >= worth:
                    near = a + np.flatnonzero(score == best)
                    return int(near[np.abs(near - at).argmin()]) + 1
        near = low + np.flatnonzero(self.aligned[low:high])
        return (int(near[np.abs(near - at).argmin()]) if len(near) else at) + 1

    def before(self, start: int, end: int) -> int:
        """An earlier end of a piece that is too long: the last boundary or mark up to SNAP tokens before, else the last landmark, else the last token that ends a character."""
        low = max(start + self.least, end - SNAP)
        found = low + np.flatnonzero((self.level[low - 1 : end - 1] > 0) | (self.mark[low - 1 : end - 1] > 0)) if low < end else ()
        if not len(found):
            marks = self.landmarks[np.searchsorted(self.landmarks, low - 1) : np.searchsorted(self.landmarks, end - 1)]
            found = marks[self.aligned[marks]] + 1
        if not len(found):
            found = start + 1 + np.flatnonzero(self.aligned[start : end - 8])
        return int(found[-1]) if len(found) else end - 8


def pieces(text: str, tokenizer, lengths: np.ndarray, gear: np.ndarray, limit: int, overlap: int, least: int):
    """(start_token, n_tokens, overlap_tokens, overlap_chars, text) of each piece, nothing for a text up to the limit."""
    raw = text.encode("utf-8", "replace")
    if len(raw) <= limit:  # a token has at least one byte
        return
    tokens = np.array(encode(tokenizer, text), dtype=np.int64)
    if len(tokens) <= limit:
        return
    cutter, start = Cutter(tokens, raw, lengths, gear, limit, overlap, least), 0
    said = lambda a, z: raw[cutter.at[a] : cutter.at[z]].decode("utf-8", "replace")
    while start < len(tokens):
        end, begin = cutter.after(start), max(0, start - overlap)
        piece = said(begin, end)
        if begin and not cutter.level[begin - 1] and end - begin > limit - 16:
            # The piece starts inside a word: alone it may have a few more tokens.
            while end - start > 8 and len(encode(tokenizer, piece)) > limit:
                end = cutter.before(start, end)
                piece = said(begin, end)
        yield begin, end - begin, start - begin, len(said(begin, start)), piece
        start = end


def split_texts(docs: DataFrame, id_: str, text: str, limit: int = 1024, overlap: int = 64, least: int = 320, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_, piece_no, start_token, n_tokens, overlap_tokens, overlap_chars, text): the pieces of each text longer than ``limit`` tokens.

    Pieces count from 1 and have at most ``limit`` tokens; each but the first starts with the last ``overlap`` tokens of the one before.
    Without these (their first ``overlap_chars`` characters) the pieces are the whole text. Texts up to the limit, empty ones and nulls have no row here. A text without any white
    space is cut between tokens; where a character is spread over tokens and a piece starts inside it, that character is replaced (U+FFFD).
    Token counts are those of the piece's tokens within the text; a piece whose overlap starts inside a word may come to a few more or
    fewer tokens when it is tokenized alone, and is shortened if that would exceed the limit. Texts are processed whole, one at a time.
    """
    kind = docs.schema[id_].dataType.simpleString()
    columns = ["id", "piece_no", "start_token", "n_tokens", "overlap_tokens", "overlap_chars", "text"]

    def work(batches):
        tokenizer = encoding(vocabulary)
        lengths, gear = _tables(vocabulary)
        for b in batches:
            out, held = [], 0
            for key, said in zip(b["id"], b["text"]):
                for no, piece in enumerate(pieces(said, tokenizer, lengths, gear, limit, overlap, least), 1):
                    out.append((key, no, *piece))
                    held += len(piece[-1])
                if held > 8_000_000:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInPandas(work, f"id {kind}, piece_no int, start_token long, n_tokens long, overlap_tokens long, overlap_chars int, text string").withColumnRenamed("id", id_)
