"""SentencePiece encoding and decoding by a Viterbi search shared over common prefixes.

A text is escaped (each space becomes the mark, one mark is put in front) and cut where no piece of the vocabulary can
reach across: in front of a run of marks, and around characters that no longer piece holds. The distinct words of a
batch are sorted and walked as a trie, depth first: going from one word to the next, only the characters beyond their
common prefix are searched again, since forward scores depend on the prefix alone. Words are kept between batches up to
``MEMORY`` characters, which bears on speed only. A very long word (text without spaces) is searched in stretches, each
cut where all open segmentations agree, so that its result is that of one search.

The segmentation is the one of highest total piece score; on ties a piece that starts earlier wins. The public model
file was made for merging pairs; here its pieces and scores are searched as a unigram model's. A character without a piece becomes its UTF-8 byte pieces.

Defined results: null and empty texts have no pieces; decoding gives the text back, except that the mark itself decodes
to a space; rows are taken one by one, repeated rows too; an empty table gives an empty result. Columns other than id
and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of distinct words that a task remembers.
MEMORY = 4_000_000
#: A longer word is searched by itself, in stretches of so many characters.
LONG = 1_000
#: A character without a piece scores this much below the lowest piece.
UNKNOWN = 10.0
MODEL = "piece_bpe_32k.model"
ENCODED = "doc_id long, n_pieces long, ids array<int>, decoded string, exact boolean"


def model_path() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.score, self.bytes = {}, {}
        plain = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece] = (model.get_score(i), i)
                plain.append(piece)
        #: All pieces read from their ends: a character leads to (further characters, score, id), score null if none ends.
        self.endings: dict = {}
        for piece in plain:
            level = self.endings
            for c in piece[:0:-1]:
                level = level.setdefault(c, ({}, None, -1))[0]
            further = level.get(piece[0], ({},))[0]
            level[piece[0]] = (further, *self.score[piece])
        self.longest = max(map(len, plain))
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN
        self.unknown_id = model.unk_id()
        joined = {c for piece in plain if len(piece) > 1 for c in piece}
        if any(MARK in piece.lstrip(MARK) for piece in plain):
            raise ValueError("a piece holds the mark behind another character")
        #: White space that no longer piece holds: words end before it and begin after it.
        self.cuts = "".join(c for c in "\n\r\t\x0b\x0c" if c not in joined)
        out = re.escape(self.cuts)
        self.words = re.compile(f"[{out}]|{MARK}*[^{MARK}{out}]+|{MARK}+" if out else f"{MARK}*[^{MARK}]+|{MARK}+")
        #: What a piece decodes to.
        self.raw = [b""] * len(self.pieces)
        for piece, (_, i) in self.score.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])

    def spell(self, character: str) -> list[int]:
        """Ids of a character that has no piece."""
        return [self.bytes.get(b, self.unknown_id) for b in character.encode()] if self.bytes else [self.unknown_id]


def _forward(word: str, state: tuple[list, list, list], vocabulary: Vocabulary) -> None:
    """Extend the forward state (best score of each prefix, where its last piece starts, its id) to all of ``word``."""
    endings, unknown = vocabulary.endings, vocabulary.unknown
    best, start, ids = state
    for end in range(len(best), len(word) + 1):
        begin = at = end - 1
        top, piece_id, level = best[begin] + unknown, -1, endings
        while begin >= 0:
            node = level.get(word[begin])
            if node is None:
                break
            level, value, number = node
            if value is not None and best[begin] + value >= top:
                top, at, piece_id = best[begin] + value, begin, number
            begin -= 1
        best.append(top)
        start.append(at)
        ids.append(piece_id)


def _backward(word: str, end: int, state: tuple[list, list, list], vocabulary: Vocabulary) -> list[int]:
    """Ids of the best segmentation of the first ``end`` characters."""
    _, start, ids = state
    out = []
    while end > 0:
        out.append([ids[end]] if ids[end] >= 0 else vocabulary.spell(word[end - 1]))
        end = start[end]
    return [i for part in reversed(out) for i in part]


def search(words: list[str], vocabulary: Vocabulary) -> dict[str, list[int]]:
    """Best segmentation of every word; ``words`` are walked in sorted order as the paths of a trie."""
    found, state, before = {}, ([0.0], [0], [-1]), ""
    for word in sorted(words):
        if len(word) > LONG:
            found[word] = search_long(word, vocabulary)
            continue
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        for values in state:
            del values[shared + 1 :]
        _forward(word, state, vocabulary)
        found[word] = _backward(word, len(word), state, vocabulary)
        before = word
    return found


def search_long(word: str, vocabulary: Vocabulary) -> np.ndarray:
    """``search`` of one word of any length, with the state of a stretch of it.

    Later pieces start at one of the last ``longest`` prefixes. Where the best segmentations of all of these go through
    one place, everything before it is settled: its ids are put out and its state is dropped.
    """
    out, state, first = [], ([0.0], [0], [-1]), 0
    for stop in range(LONG, len(word) + LONG, LONG):
        part = word[first:stop]
        _forward(part, state, vocabulary)
        start, settled = state[1], len(part)
        if stop < len(word):
            open_ends = set(range(max(0, len(part) - vocabulary.longest + 1), len(part) + 1))
            while len(open_ends) > 1:
                last = max(open_ends)
                open_ends.remove(last)
                open_ends.add(start[last])
            settled = open_ends.pop()
        out.append(np.array(_backward(part, settled, state, vocabulary), np.int32))
        state = state[0][settled:], [x - settled for x in start[settled:]], state[2][settled:]
        first += settled
    return np.concatenate(out)


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of a piece sequence, without the mark put in front."""
    raw = vocabulary.raw
    text = b"".join(b"".join([raw[i] for i in ids[lo : lo + 100_000].tolist()]) for lo in range(0, len(ids), 100_000)).decode(
        "utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encoder(path: str, carried: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        number: dict[str, int] = {}
        flat, sizes, held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        for whole in batches:
            texts = ["" if t is None else t for t in whole.column("text").to_pylist()]
            for lo, hi in _groups(texts):
                if held > MEMORY:
                    number, flat, sizes, held = {}, flat[:0], sizes[:0], 0
                cut = [vocabulary.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[lo:hi]]
                found = search(list(set(chain.from_iterable(cut)).difference(number)), vocabulary)
                number.update(zip(found, range(len(number), len(number) + len(found))))
                held += sum(map(len, found))
                flat = np.append(flat, np.fromiter(chain.from_iterable(found.values()), np.int32))
                sizes = np.append(sizes, np.fromiter(map(len, found.values()), np.int64))
                # The pieces of all words of the group, one after the other.
                word = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
                n = sizes[word]
                ends = np.cumsum(n)
                first = (np.cumsum(sizes) - sizes)[word]
                pieces = flat[np.repeat(first - (ends - n), n) + np.arange(n.sum())]
                words = np.append(0, np.cumsum([len(x) for x in cut]))
                offsets = np.append(0, ends)[words].astype(np.int32)
                ids = np.split(pieces, offsets[1:-1])
                counts = np.diff(offsets)
                decoded = [decode(x, vocabulary) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [whole.column("doc_id")[lo:hi], pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(pieces)),
                     pa.array(decoded, pa.string()), pa.array([a == b for a, b in zip(decoded, texts[lo:hi])]),
                     *[whole.column(c)[lo:hi] for c in carried]],
                    ["doc_id", "n_pieces", "ids", "decoded", "exact", *carried])

    return work


def _groups(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 carried: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded, exact): pieces of every text, their text again, and whether both agree.

    ``path`` is the model file, which has to lie at the same place on every executor. ``carried`` are long columns that
    go along with each document.
    """
    carried = carried or {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[c.cast("long").alias(name) for name, c in carried.items()])
    return rows.mapInArrow(_encoder(path or model_path(), list(carried)),
                           ", ".join([ENCODED, *[f"{name} long" for name in carried]]))
