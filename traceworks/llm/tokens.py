"""Token counts of byte-level pair-merge tokenizers by rank-synchronous array merging.

A text is cut into pre-tokens by the tokenizer's pattern. The distinct new pre-tokens of a group of texts lie in one
ragged numpy array of byte symbols; in every round each sequence applies the pair of lowest rank that it holds, at all
its places, all sequences at once, until none holds a pair. The symbols that survive are the tokens. Only ranks next to
a merge are looked up again. Sequences are cut beforehand between bytes that stand together in no token. The few that
are left after ``ROUNDS`` rounds, very long ones, go on rank by rank over linked arrays: a round then costs only the
places where its rank stands.

Merging all places of a rank together equals merging them one by one if a pair's parts are always made by lower ranks;
the tokenizer file is checked for that. Where the pattern library knows other letters or digits than the tokenizer's
own (they follow different Unicode versions), which is tested for every character met, the tokenizer's own cuts are
taken for the text. Special tokens inside a text count as one token each, as is the library's default.

Defined results: null counts as empty text, an empty text has no tokens; rows are taken one by one, repeated rows and
rows without an id too; an empty table gives an empty result. Columns other than id and text are not read. Counts of
pre-tokens are remembered up to ``MEMORY`` characters, and a long text is worked on in stretches, which bears on
memory and speed only.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the cuts of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of remembered pre-tokens, of one remembered pre-token, and of a group of texts.
MEMORY, SHORT, GROUP = 20_000_000, 64, 1_000_000
ROUNDS = 48
#: The rank of no pair.
NONE = np.int32(2**31 - 1)
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the file: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


def _runs(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Every second place of each run of overlapping ones; ``follows``: whether place k + 1 overlaps place k."""
    if not follows.any():
        return at
    number = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.append(False, follows), 0, number))
    return at[(number - first) % 2 == 0]


class Merges:
    """The merge ranks of a tokenizer file, and the search for the symbols that survive them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if (model["type"], cut["type"]) != ("BPE", "ByteLevel") or cut["add_prefix_space"] or not cut["use_regex"] or \
                spec["normalizer"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("not a plain byte-level pair-merge tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        vocabulary, letters = model["vocab"], byte_letters()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in part], np.int64)
                             for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.bytes = np.array([vocabulary[c] for c in letters], np.int32)
        self.made, self.size = made.astype(np.int32), len(vocabulary)
        rank = np.full(self.size, len(pairs), np.int64)
        rank[self.bytes] = -1
        rank[made] = np.arange(len(pairs))
        if len(np.unique(made)) < len(pairs) or (np.maximum(rank[left], rank[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before its parts, or two merges make one token")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        #: Whether two bytes stand together in any token.
        byte = {c: b for b, c in enumerate(letters)}
        self.joined = np.zeros((256, 256), bool)
        for token in vocabulary:
            if all(c in byte for c in token):
                spelt = [byte[c] for c in token]
                self.joined[spelt[:-1], spelt[1:]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive in each (not empty) word."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.zeros(len(raw), bool)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.cumsum(sizes) - sizes
        begin[1:] = ~self.joined[raw[:-1], raw[1:]]
        begin[word] = True
        starts = np.flatnonzero(begin)
        survived = self.survivors(self.bytes[raw], starts)
        return np.add.reduceat(survived, np.searchsorted(starts, word))

    def survivors(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; sequence k is symbols[starts[k]:starts[k + 1]]."""
        sizes = np.diff(np.append(starts, len(symbols)))
        out, owner = sizes.copy(), np.arange(len(starts))
        ranks = np.full(len(symbols), NONE)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[starts + sizes - 1] = NONE
        for _ in range(ROUNDS):
            if not len(owner):
                return out
            lowest = np.minimum.reduceat(ranks, starts)
            open_ = lowest != NONE
            out[owner[~open_]] = sizes[~open_]
            if not open_.all():
                stay = np.repeat(open_, sizes)
                symbols, ranks, owner, sizes, lowest = symbols[stay], ranks[stay], owner[open_], sizes[open_], lowest[open_]
                starts = np.cumsum(sizes) - sizes
                if not len(owner):
                    return out
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            at = _runs(at, np.diff(at) == 1)
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            sizes = sizes - np.add.reduceat(~stay, starts)
            symbols, ranks, at = symbols[stay], ranks[stay], (np.cumsum(stay) - 1)[at]
            starts = np.cumsum(sizes) - sizes
            first, last = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
            first[starts], last[starts + sizes - 1] = True, True
            ranks[at] = NONE
            near = np.append(at[~last[at]], at[~first[at]] - 1)
            ranks[near] = self.rank(symbols[near], symbols[near + 1])
        if len(owner):
            out[owner] = self.by_rank(symbols, ranks, starts, sizes)
        return out

    def by_rank(self, symbols: np.ndarray, ranks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence, going up the ranks; neighbours are linked, places are listed by rank."""
        right, left = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        right[starts + sizes - 1], left[starts] = -1, -1
        alive = np.ones(len(symbols), bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[ranks[places] != NONE]
            places = places[np.argsort(ranks[places], kind="stable")]
            for part in np.split(places, np.flatnonzero(np.diff(ranks[places])) + 1):
                if len(part):
                    r = int(ranks[part[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(part)

        add(np.arange(len(symbols)))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (ranks[at] == r)]
            at = _runs(at, right[at[:-1]] == at[1:])
            gone = right[at]
            symbols[at] = self.made[r]
            alive[gone], ranks[gone] = False, NONE
            after = right[gone]
            right[at] = after
            left[after[after >= 0]] = at[after >= 0]
            near = np.unique(np.append(at, left[at][left[at] >= 0]))
            ranks[near] = NONE
            near = near[right[near] >= 0]
            ranks[near] = self.rank(symbols[near], symbols[right[near]])
            add(near)
        return np.add.reduceat(alive.astype(np.int64), starts)


class Counter:
    """Token counts of texts, with what is remembered from text to text."""

    def __init__(self, path: str):
        import regex

        self.merges, self.path = Merges(path), path
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.known: dict[str, int] = {}
        self.characters = 0
        self.met: set[str] = set(map(chr, range(128)))
        self.disputed: set[str] = set()
        self.own = None

    def _look_at(self, texts: list[str]) -> None:
        """Test whether both libraries cut around each new character alike."""
        new = set().union(*[t for t in texts if not t.isascii()]) - self.met
        if new and self.own is None:
            from tokenizers import pre_tokenizers

            self.own = pre_tokenizers.ByteLevel(add_prefix_space=False)
        for c in new:
            probe = f"a{c}a 1{c}1.{c}.  {c}\n"
            if [p[1] for p in self.own.pre_tokenize_str(probe)] != [m.span() for m in self.pattern.finditer(probe)]:
                self.disputed.add(c)
        self.met |= new

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a stretch of text without special tokens."""
        if self.disputed and not self.disputed.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each of a group of stretches without special tokens."""
        self._look_at(texts)
        cut = [self.words(t) for t in texts]
        if self.characters > MEMORY:
            self.known, self.characters = {}, 0
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if new:
            counts = self.merges.counts([w.encode() for w in new]).tolist()
            self.known.update(zip(new, counts))
        out = [sum(map(self.known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > SHORT:
                del self.known[w]
            else:
                self.characters += len(w)
        return out

    def stretches(self, text: str) -> Iterator[str]:
        """A text in parts of about ``GROUP`` characters, cut in front of white space, where a pre-token always begins."""
        start = 0
        while len(text) - start > GROUP:
            cut = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])").search(text, start + GROUP)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        if start < len(text):
            yield text[start:]


def _counter(path: str, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for whole in batches:
            texts = ["" if t is None else t for t in whole.column("text").to_pylist()]
            total = [0] * len(texts)
            owners, group, size = [], [], 0

            def close() -> None:
                nonlocal owners, group, size
                for k, n in zip(owners, counter.count(group)):
                    total[k] += n
                owners, group, size = [], [], 0

            for k, text in enumerate(texts):
                parts = [text]
                if counter.special is not None:
                    parts = counter.special.split(text)
                    total[k] += len(parts) - 1
                for part in parts:
                    for stretch in counter.stretches(part):
                        owners.append(k)
                        group.append(stretch)
                        size += len(stretch)
                        if size >= GROUP:
                            close()
            close()
            tokens = pa.array(total, pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(whole.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([whole.column("doc_id"), n_bytes, tokens, pc.greater(tokens, limit)],
                                             [c.split()[0] for c in COUNTS.split(", ")])

    return work


def token_counts(docs: DataFrame, limit: int, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of every text, and whether these exceed ``limit``.

    ``path`` is the tokenizer file, which has to lie at the same place on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(path or tokenizer_path(), limit), COUNTS)
