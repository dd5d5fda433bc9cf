"""Operator 6: byte-level BPE by a traversal of a trie that shares prefixes.

The distinct words of a batch form one trie.  For the prefix at each node exactly one
token can come last in its encoding; a depth-first walk finds that token from the states
of the nodes above: it is the vocabulary token that ends here and, where it begins, fits
the last token there.  The encoding of a prefix is computed once for all words below it.
A word's ids are read back along the last tokens.

Two tokens fit if BPE, run on both together, would not merge across their border.  Undoing
their merges, the latest first, shows every pair that ever met at the border; none of these
may have a merge rule that comes before the merge just undone.

Defined results: a null text counts as empty (no ids, empty text); equal ids and texts are
kept as they are; an empty table gives an empty result; other columns pass through only
where the caller asks for them.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import storage, workers
from .pieces import interned, pieces

#: The pre-tokenisation pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, words and pairs a worker remembers before it starts anew; bounds memory only.
MEMO = 300_000
#: Bytes of two words that are compared at once to find where they part; longer shared beginnings are followed byte by byte.
_HEAD = 24


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class TrieBpe:
    """A byte-level vocabulary, from the JSON of the tokenizers library."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        names = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in names.items() if all(c in byte_of for c in t)}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        for content in self.special:
            self.ids.pop(content.encode(), None)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # id: rank of its merge, the two halves
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            halves = self.ids[a], self.ids[b]
            self.rank[halves] = rank
            self.made.setdefault(self.ids[a + b], (rank, *halves))
        # A token that its own merges do not build never comes out of BPE.
        self.reachable = {t: i for t, i in self.ids.items() if len(t) == 1 or (i in self.made and self._fits(*self.made[i][1:], self.made[i][0]))}
        by_tail: dict[bytes, set[int]] = {}
        for t in self.reachable:
            if len(t) > 2:
                by_tail.setdefault(t[-3:], {2} if t[-2:] in self.reachable else set()).add(len(t))
        #: The lengths of the tokens of two bytes or more that end in three given bytes, longest first.
        self.lengths = {tail: tuple(sorted(some, reverse=True)) for tail, some in by_tail.items()}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.known_words: dict[str, list[int]] = {}
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _fits(self, a: int, b: int, below: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``below`` crosses the border of ``a`` and ``b``.

        A pair that meets at the border crosses it if its rule comes before the merge that
        took it apart; at equal rank the left of two pairs is merged first.
        """
        limit = below
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_b is not None and (made_a is None or made_b[0] >= made_a[0]):
                limit, b = made_b[0] + 1, made_b[1]
            elif made_a is not None:
                limit, a = made_a[0], made_a[2]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        known = self.fits_memo.get((a, b))
        if known is None:
            if len(self.fits_memo) > 2 * MEMO:
                self.fits_memo.clear()
            known = self.fits_memo[a, b] = self._fits(a, b)
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct words.

        Sorted, the words are the ends of their trie's branches in depth-first order.  The walk
        holds the path from the root to the node it is at, with the last token of the prefix at
        each node; from one word to the next it goes back to the node where they part.
        """
        order = sorted(words)
        heads = np.array(order, dtype=f"S{_HEAD}").view(np.uint8).reshape(len(order), _HEAD) if order else np.zeros((0, _HEAD), np.uint8)
        shared = np.concatenate([[0], np.cumprod(heads[1:] == heads[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)]).tolist() if order else []
        found: dict[bytes, list[int]] = {}
        token, lengths, known, fits = self.reachable.get, self.lengths.get, self.fits_memo.get, self.fits
        last, size, before = [-1], [0], b""  # by depth: the last token of the prefix, and its length
        for word, same in zip(order, shared, strict=True):
            most = min(len(before), len(word))
            same = min(same, most)
            if same == _HEAD:
                while same < most and word[same] == before[same]:
                    same += 1
            del last[same + 1 :], size[same + 1 :]
            before = word
            for depth in range(same + 1, len(word) + 1):
                some = lengths(word[depth - 3 : depth]) if depth > 2 else None
                for n in some if some is not None else (2,):
                    if n <= depth:
                        start = depth - n
                        t = token(word[start:depth])
                        if t is not None and (not start or known((last[start], t)) or fits(last[start], t)):
                            break
                else:
                    n, t = 1, token(word[depth - 1 : depth])
                last.append(t)
                size.append(n)
            ids, k = [], len(word)
            while k:
                ids.append(last[k])
                k -= size[k]
            ids.reverse()
            found[word] = ids
        return found

    def split(self, text: str) -> list[str]:
        """Pre-tokens of ``text``, special tokens among them whole."""
        if self.specials is None or not any(x in text for x in self.special):
            return self.words.findall(text)
        return [w for part in self.specials.split(text) if part for w in ([part] if part in self.special else self.words.findall(part))]

    def encode_pieces(self, some: Iterable[str]) -> dict[str, list[int]]:
        split = {p: self.split(p) for p in some}
        if len(self.known_words) > MEMO:
            self.known_words.clear()
        ids = self.known_words
        new = {w for words in split.values() for w in words if w not in ids}
        ids.update({w: [self.special[w]] for w in new if w in self.special})
        of = self.encode_words(w.encode() for w in new if w not in self.special)
        ids.update((w.decode(), i) for w, i in of.items())
        return {p: [i for w in words for i in ids[w]] for p, words in split.items()}

    def encode(self, text: str) -> list[int]:
        parts = pieces(text)
        of = self.encode_pieces(set(parts))
        return [i for p in parts for i in of[p]]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_BY_VOCABULARY: dict[int, tuple[TrieBpe, dict]] = {}
workers.remembers("bpe", _BY_VOCABULARY.clear)


def _worker(vocabulary: str) -> tuple[TrieBpe, dict]:
    workers.begin("bpe")
    key = hash(vocabulary)
    if key not in _BY_VOCABULARY:
        _BY_VOCABULARY[key] = TrieBpe(vocabulary), {}
    return _BY_VOCABULARY[key]


def _shared_vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a few MB


def encode(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the token ids of ``text_col``; an existing column of that name is replaced."""
    storage.prepare_python(docs.sparkSession)
    vocabulary = _shared_vocabulary(docs, vocabulary_path)
    rest = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = _worker(vocabulary.value)
        for batch in batches:
            distinct, codes, starts = interned(batch.column(text_col))
            lists, _ = _id_lists(_learned(bpe, known, distinct), codes, starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out_col])

    schema = StructType([*rest.schema.fields, StructField(out_col, ArrayType(IntegerType()))])
    return rest.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``, the text of ``ids_col`` (null: empty); unknown ids fail."""
    storage.prepare_python(rows.sparkSession)
    vocabulary = _shared_vocabulary(rows, vocabulary_path)
    rest = rows.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _worker(vocabulary.value)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(out_col, StringType())]))


def _learned(bpe: TrieBpe, known: dict, distinct: list[str]) -> list[tuple]:
    """What each piece gives: ids, ids as text with a comma after each, decoded bytes."""
    if len(known) > MEMO:
        known.clear()
    for piece, ids in bpe.encode_pieces([p for p in distinct if p not in known]).items():
        known[piece] = array("i", ids), ("%d," * len(ids) % tuple(ids)).encode(), b"".join(map(bpe.bytes_of.__getitem__, ids))
    return [known[p] for p in distinct]


def _id_lists(got: list[tuple], codes: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The ids of each text as a list, and how many ids each has."""
    sizes = np.array([len(x[0]) for x in got], np.int64)
    flat = np.frombuffer(b"".join([x[0].tobytes() for x in got]), np.int32)
    own = sizes[codes]
    before = np.concatenate([[0], np.cumsum(own)])
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - before[:-1], own) + np.arange(before[-1])]
    offsets = before[starts]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), np.diff(offsets)


def digests(docs: DataFrame, vocabulary_path: str, *, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, the sha256 of its ids and of its decoded text; with_ids: also the ids."""
    from hashlib import sha256

    storage.prepare_python(docs.sparkSession)
    vocabulary = _shared_vocabulary(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = _worker(vocabulary.value)
        for batch in batches:
            distinct, codes, starts = interned(batch.column("text"))
            got = _learned(bpe, known, distinct)
            lists, sizes = _id_lists(got, codes, starts)
            listed, raw, ids, texts = [x[1] for x in got], [x[2] for x in got], [], []
            for a, b in zip(starts, starts[1:]):
                doc = codes[a:b].tolist()
                ids.append(sha256(b"".join([listed[c] for c in doc])[:-1]).hexdigest())
                texts.append(sha256(b"".join([raw[c] for c in doc]).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), *([lists] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
