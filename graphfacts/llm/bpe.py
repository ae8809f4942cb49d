"""BPE encoding and decoding with a public tokenizer file.

A word's adjacent pairs form the leaves of a segment tree over their merge ranks: the root is the leftmost pair of
lowest rank, and a merge is a few point updates of logarithmic cost, until no mergeable pair remains. That holds for
words of any length. Texts are cut at white space, which no token spans, and what a chunk encodes to is kept for the
chunks that recur.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from graphfacts.llm.shared import columns, remembers, text_of, working

#: Words and chunks whose encoding a worker keeps (two generations of each at most), and the longest that is kept. A
#: pipeline whose workers hold other things as well names less.
KEEP, KEEP_CHARS = 250_000, 48

# The word pattern of the tokenizer file restricted to ASCII and Latin-1 letters, where the standard
# library agrees with it; other chunks go through the file's own normaliser and pre-tokenizer.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# White space by the Unicode property; str.split() also cuts at the four separators 1C to 1F.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"


def merged(ids: list[int], rank: dict[int, int], made: Sequence[int]) -> list[int]:
    """The ids of one word after all merges. ``rank`` gives the rank of a pair (first id in the upper bits), ``made``
    the token that each rank makes.

    ``tree`` is a segment tree for minima over the pairs, a pair standing at its left symbol's place; a leaf is rank
    times length plus place, so the root is the leftmost pair of lowest rank, or ``never`` when none can be merged.
    """
    n = len(ids)
    if n < 2:
        return ids
    get, never = rank.get, len(made) * n
    size = 1 << (n - 2).bit_length()
    tree = [never] * (2 * size)
    last = ids[0]
    for i in range(1, n):
        here = ids[i]
        r = get(last << 16 | here)
        if r is not None:
            tree[size + i - 1] = r * n + i - 1
        last = here
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    low = tree[1]
    if low == never:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while low < never:
        r, i = divmod(low, n)
        j = after[i]
        k = after[j]
        ids[i] = made[r]
        after[i], before[k] = k, i
        h = before[i]
        # the pair that began at j is gone, the pairs on either side of the new symbol have changed
        for leaf, left, right in ((j, -1, n), (i, i, k), (h, h, i)):
            if leaf < 0 or leaf >= size:
                continue
            value = never
            if right < n:
                r = get(ids[left] << 16 | ids[right])
                if r is not None:
                    value = r * n + leaf
            k = size + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
        low = tree[1]
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Kept(dict):
    """A memory of what ``make`` gave: two generations, so that what recurs stays and the size is bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEEP_CHARS:
            self[key] = value
        return value

    def tidy(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encoder and decoder for one tokenizer file.

    ``form`` turns a chunk's ids into what is kept of it. ``by_library`` lets the tokenizers library merge single
    words (the same ids, sooner); otherwise the segment tree does.
    """

    def __init__(self, path: str, form: Callable, by_library: bool = False, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        if len(self.tokens) > 1 << 16:
            raise ValueError("token ids are packed in 16 bits")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        end = model["end_of_word_suffix"] or ""
        self.first = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c: vocab[c + end] for c in self.first if c + end in vocab}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a] << 16 | vocab[b]] = r
            self.made.append(vocab[a + b])
        # the printable stand-in of every byte, as the file's pre-tokenizer writes it
        shown = lambda text: "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        self.shown = {ord(c): shown(c) for c in map(chr, [*range(33, 127), *range(192, 256)]) if c not in "×÷"}
        self.by_library = by_library
        self.words = Kept(self._word, keep)
        self.chunks = Kept(lambda chunk: form(self._chunk(chunk)), keep)
        self.form = form

    def _word(self, piece: str) -> list[int]:
        """Ids of one pre-token, given in printable stand-ins."""
        if self.by_library:
            return [t.id for t in self.library.model.tokenize(piece)]
        ids = [self.first[c] for c in piece]
        ids[-1] = self.last[piece[-1]]
        return merged(ids, self.rank, self.made)

    def _chunk(self, chunk: str) -> list[int]:
        words = self.words
        if PLAIN.fullmatch(chunk):
            pieces = [p.translate(self.shown) for p in PIECES.findall(chunk.lower())]
        else:
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        return [i for p in pieces for i in words[p]]

    def encode(self, text: str) -> list:
        """What ``form`` keeps of each chunk, in order. The file's special tokens are recognised in the text."""
        self.words.tidy()
        self.chunks.tidy()
        if "<|" in text and self.at_added:
            out: list = []
            for part in self.at_added.split(text):
                out += [self.form([self.added[part]])] if part in self.added else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list:
        chunks = self.chunks
        if any(c in text for c in SEPARATORS):
            return [chunks[c] for c in WHITE.split(text) if c]
        return [chunks[c] for c in text.split()]

    def decode(self, ids: Sequence[int]) -> str:
        """The file names no decoder: the tokens' own text, joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def _digest_codec(path: str) -> Codec:
    """Each chunk as the bytes that both digests take of it, and its number of ids; None if it has none."""

    def form(ids: list[int]) -> tuple | None:
        return (" ".join([digits[i] for i in ids]).encode(), codec.decode(ids).encode(), len(ids)) if ids else None

    codec = Codec(path, form)
    digits = [str(i) for i in range(len(codec.tokens))]
    return codec


@lru_cache(maxsize=2)
def id_codec(path: str, keep: int = KEEP) -> Codec:
    """Each chunk as packed 16-bit ids; words are merged by the library."""
    return Codec(path, lambda ids: array("H", ids).tobytes(), by_library=True, keep=keep)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every whole text, ``tokenizer`` being the path of the file on the executors.
    Null texts are empty and give no ids; one row per input row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe")
        codec = _lists(tokenizer)
        for doc, texts in columns(batches, "doc_id", "text"):
            ids = [[i for part in codec.encode(t) for i in part] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = text_of(docs)
    kind = _arrow(rows)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


@lru_cache(maxsize=2)
def _lists(path: str) -> Codec:
    return Codec(path, lambda ids: ids)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``: special tokens are kept; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe")
        codec = _lists(tokenizer)
        for doc, ids in columns(batches, "doc_id", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array([codec.decode(i or []) for i in ids], pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    kind = _arrow(rows)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc_id"].dataType)


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row: digests of the ids (decimal, joined by
    one space) and of the text decoded from them. An empty or null text has no ids and decodes to an empty text.
    Encoding and decoding run chunk by chunk in one pass, so neither list is ever moved; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe")
        codec = _digest_codec(tokenizer)
        for doc, texts in columns(batches, "doc_id", "text"):
            counts, of_ids, of_text = [], [], []
            for t in texts:
                ids, decoded, n = tuple(zip(*filter(None, codec.encode(t)))) or ((), (), ())
                counts.append(sum(n))
                of_ids.append(sha256(b" ".join(ids)).hexdigest())
                of_text.append(sha256(b" ".join(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, kind), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = text_of(docs)
    kind = _arrow(rows)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _forget() -> None:
    for codec in (_digest_codec, id_codec, _lists):
        codec.cache_clear()


remembers("bpe", _forget)
