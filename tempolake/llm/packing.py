"""Cost-balanced packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released

LENGTH = 2048
END = 1
#: Documents and tokens that a task packs together; memory is bounded by the larger of this and one document.
GROUP_DOCS, GROUP_TOKENS = 8192, 2_000_000
#: Words and pieces of words whose ids a task remembers. Pieces, which cost the most, are fewer and are kept longer.
CACHE_WORDS, CACHE_PIECES = 300_000, 700_000

SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# The vocabulary's own splitting rule, for words of Latin-1 characters, and the line ends between words. Fixed values.
_PIECES = re.compile("\\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable byte stands for itself, the others for letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Slots(dict):
    """Places of strings; a string that has none gets the next one and is noted in ``new``."""

    def __missing__(self, name: str) -> int:
        k = self[name] = len(self)
        self.new.append(name)
        return k


class _Ids:
    """Remembered ids of strings; ``none`` has none."""

    def __init__(self, none: str):
        self.slot = _Slots({none: 0})
        self.slot.new = []
        self.flat, self.starts, self.sizes = array("I"), array("q", [0]), array("q", [0])

    def find(self, names: list[str]) -> tuple[np.ndarray, list[str]]:
        """(places of the strings, the new ones among them in order), whose ids are to be added next."""
        slots = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        new, self.slot.new = self.slot.new, []
        return slots, new

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids`` are those of all new strings in order, ``sizes`` of each."""
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings in ``slots``, in order, how many each has)."""
        sizes = np.frombuffer(self.sizes, np.int64)[slots]
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        begins = np.frombuffer(self.starts, np.int64)[slots] - (np.cumsum(sizes) - sizes)
        return flat[np.repeat(begins, sizes) + np.arange(sizes.sum())], sizes


class WordEncoder:
    """Ids of whole texts, exactly the tokenizer's own, from remembered ids of their words.

    The vocabulary drops white space before it splits, so no token crosses a blank or a line end and the ids of a text
    are those of its words in order. Words of printable Latin-1 characters are lower-cased and split by the vocabulary's
    rule, and their pieces given to the merge model, all new ones in one call; any other word goes through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.merge = Tokenizer(self.whole.model)
        self.merge.pre_tokenizer = WhitespaceSplit()
        self.letters = {b: c for b, c in _byte_letters().items() if b != 0x20}
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # a piece's last token, and no other, is marked
        self.last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Drops all remembered ids; the vocabulary stays."""
        self.words, self.pieces = _Ids(""), _Ids("\n")

    def _merged(self, pieces: list[str]) -> np.ndarray:
        as_bytes = " ".join(pieces).encode().decode("latin-1").translate(self.letters)
        return np.array(self.merge.encode_batch_fast([as_bytes], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        odd = [k for k, w in enumerate(words) if not w.isprintable() or not (w.isascii() or max(w) <= "\xff") or "<|" in w or " " in w]
        plain = words.copy()
        for k in odd:
            plain[k] = ""
        pieces = _PIECES.findall("\n".join(plain).lower() + "\n")
        slots, new = self.pieces.find(pieces)
        if new:
            ids = self._merged(new)
            self.pieces.add(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
        ids, sizes = self.pieces.of(slots)
        sizes = np.diff(np.cumsum(sizes)[slots == 0], prepend=0)  # a line end is slot 0, without ids
        if odd:
            each = [e.ids for e in self.whole.encode_batch([words[k] for k in odd], add_special_tokens=False)]
            ids = np.insert(ids, np.repeat(np.cumsum(sizes)[odd], list(map(len, each))), [x for e in each for x in e])
            sizes[odd] = list(map(len, each))
        self.words.add(ids, sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words.slot) > CACHE_WORDS:
            self.words = _Ids("")
        if len(self.pieces.slot) > CACHE_PIECES:
            self.pieces = _Ids("\n")
        split = [t.replace("\n", " ").split(" ") for t in texts]
        slots, new = self.words.find([w for s in split for w in s])
        if new:
            self._learn(new)
        ids, sizes = self.words.of(slots)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(s) for s in split])]
        return np.split(ids, cuts[:-1])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cost(n, length: int = LENGTH):
    """Estimated cost of a piece of ``n`` tokens: linear layers and quadratic attention, equal at ``length`` tokens."""
    return n + n * n / length


def pack(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with ``sizes`` tokens.

    Whole multiples of ``length`` get sequences of their own. The rests go, longest first, to the sequence of lowest
    cost that has room; the number of sequences is the fewest that can hold them. A rest that fits nowhere whole is cut,
    its first part filling the sequence with most room; so all sequences but the last few tokens' worth are full.
    """
    out, seq = [], 0
    for d in np.flatnonzero(sizes >= length):
        for k in range(int(sizes[d]) // length):
            out.append((int(d), k * length, length, seq, 0))
            seq += 1
    rests = sizes % length
    order = np.argsort(-rests, kind="stable")
    order = order[rests[order] > 0]
    n = -(-int(rests.sum()) // length)
    used, spent = np.zeros(n, np.int64), np.zeros(n)
    for d in order:
        start, left = int(sizes[d] - rests[d]), int(rests[d])
        while left:
            at = int(np.argmin(np.where(used + left <= length, spent, np.inf)))
            if used[at] + left > length:
                at = int(np.argmin(used))
            part = min(left, length - int(used[at]))
            out.append((int(d), start, part, seq + at, int(used[at])))
            used[at] += part
            spent[at] += cost(part, length)
            start, left = start + part, left - part
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No shuffle: each task packs the documents of its own partition in groups of at most ``GROUP_DOCS`` documents, so a
    lost executor costs its own partitions only. Every document ends with ``end``, so a null or empty text is one piece
    of one token. Repeated rows and repeated or null ids are packed as documents of their own. An empty table gives no
    rows. Other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        enc, task, group, ids, tokens, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), [], [], 0, 0

        def emit():
            nonlocal seq
            sizes = np.array([len(x) for x in ids], np.int64)
            rows = pack(sizes, length)
            crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            who = pa.array(group, pa.int64()).take(pa.array(d))
            cols = [who, pa.array(s), pa.array(n), pa.array(crc, pa.int64()), pa.array(sizes[d]), pa.array((task << 40) + seq + q), pa.array(o)]
            seq += int(q.max()) + 1
            return pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        try:
            for b in batches:
                group += b.column(0).to_pylist()
                for x in enc.encode([t or "" for t in b.column(1).to_pylist()]):
                    ids.append(np.append(x, np.uint32(end)))
                    tokens += len(ids[-1])
                if len(ids) >= GROUP_DOCS or tokens >= GROUP_TOKENS:
                    yield emit()
                    group, ids, tokens = [], [], 0
            if ids:
                yield emit()
        finally:  # an executor may keep more workers than it runs tasks, and each would hold its own
            enc.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(released(run), SCHEMA)
