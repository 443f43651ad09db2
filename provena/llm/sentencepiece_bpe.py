"""SentencePiece BPE encoding by a table of merge-type prefixes, and decoding.

For a merge-type (BPE) vocabulary the last token of a prefix's encoding is unique, and a sequence of tokens is an
encoding exactly if every neighbouring pair encodes to itself. So one pass over a piece of text fills a table: at
each end position the automaton lists the tokens that end there; the one whose start position's own last token
forms a compatible pair with it is the prefix's last token. The ids are recovered backwards through the table.

Text is escaped as the library does (space to U+2581, one leading mark) and cut where no token of the vocabulary can
reach across: before a run of marks that follows another character, and around characters that are no token
(they become byte tokens). Both are checked on the vocabulary when it is loaded. Runs of marks, whose tokens share
one score and so are ordered by place as well, are merged directly by score and place.

Cases. Null text is the empty text; the empty text has only begin and end ids. Text of any length is encoded whole;
its work is linear in its length. Repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.text import chunks, only_caches_of
from provena.runtime import ship_package

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: words and pairs of tokens a worker remembers
KNOWN_UNITS, KNOWN_PAIRS = 130_000, 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Fields of a protocol-buffer message: number, wire type, value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, kind, data[at : at + size]
        at += size


class PieceModel:
    """A SentencePiece BPE model read from its file's bytes."""

    def __init__(self, blob: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        normalizer = b""
        trainer: dict[int, bytes | int] = {}
        for number, _, value in _fields(blob):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                trainer = {n: v for n, _, v in _fields(value)}
            elif number == 3:
                normalizer = value
        norm = {n: v for n, _, v in _fields(normalizer)}
        if trainer.get(3) != 2 or norm.get(2) or norm.get(4, 1) != 0 or norm.get(3, 1) != 1 or norm.get(5, 1) != 1 or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback, identity normalization and a leading mark are supported")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused tokens are not supported")
        ids = [i for i, kind in enumerate(self.kinds) if kind == NORMAL]
        self.id_of = {self.pieces[i]: i for i in ids}
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in ids):
            raise ValueError("a token reaches across the start of a word")
        self.byte_ids = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.bos = next(i for i, p in enumerate(self.pieces) if p == "<s>")
        self.eos = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        self.chars = {p for p in self.id_of if len(p) == 1}
        #: tokens whose score another token has: their order depends on the place too
        counts: dict[float, int] = {}
        for i in ids:
            if len(self.pieces[i]) > 1:
                counts[self.scores[i]] = counts.get(self.scores[i], 0) + 1
        tied = {self.pieces[i] for i in ids if len(self.pieces[i]) > 1 and counts[self.scores[i]] > 1}
        if any(p.strip(MARK) for p in tied):
            raise ValueError("tokens other than runs of marks share a score")
        #: neighbouring characters inside some token; text can be cut between any others
        self.inner = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.rank = {i: -self.scores[i] if len(self.pieces[i]) > 1 else -math.inf for i in ids}
        self.last_merge: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            # a token that does not encode to itself is never produced
            if (piece.strip(MARK) or len(piece) == 1) and self._derive(piece, i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: by token, which tokens can follow it
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.units: dict[str, tuple[int, ...]] = {}
        self.met, self.n_met = bytearray(1 << 22), 0
        # words of one script of characters, with the marks before them
        self.split = re.compile(f"{MARK}*[^{MARK}\n\t]+|{MARK}+|[\n\t]")
        self.texts = [self._surface(i) for i in range(len(self.pieces))]

    def merge(self, text: str, trace: list[tuple[int, int, int]] | None = None) -> list[int]:
        """Merge directly: best score first, leftmost on ties. Characters must be tokens. ``trace`` gets the merges."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        prior = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts):
                i = self.id_of.get(parts[a] + parts[b])
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], a, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = after[a]
            if parts[a] is None or b >= len(parts) or parts[a] + parts[b] != joined:
                continue
            if trace is not None:
                trace.append((self.id_of[parts[a]], self.id_of[parts[b]], self.id_of[joined]))
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[a] < len(parts):
                prior[after[a]] = a
            if prior[a] >= 0:
                offer(prior[a])
            offer(a)
        return [self.id_of[p] for p in parts if p is not None]

    def _derive(self, piece: str, i: int) -> bool:
        """Whether a token encodes to itself; keeps the two tokens of its last merge."""
        trace: list[tuple[int, int, int]] = []
        if self.merge(piece, trace) != [i]:
            return False
        if trace:
            if any(self.rank[x[2]] > self.rank[y[2]] for x, y in itertools.pairwise(trace)):
                raise ValueError("a token is made by merges out of order")
            self.last_merge[i] = trace[-1][:2]
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are.

        While a and b are being made, the token at a's right edge and that at b's left edge are neighbours. They
        would join instead if their union is a token whose turn comes before either edge is merged into its own
        parent (on equal rank the left one of two merges comes first).
        """
        edges = [(a, math.inf)]
        while (t := self.last_merge.get(edges[-1][0])) is not None:
            edges.append((t[1], self.rank[edges[-1][0]]))
        x, until_x = b, math.inf
        while True:
            for y, until_y in edges:
                joined = self.id_of.get(self.pieces[y] + self.pieces[x])
                # they meet only if each is made before the other is merged away
                if joined is not None and self.rank[y] < until_x and self.rank[x] < until_y:
                    rank = self.rank[joined]
                    if rank < until_y and rank <= until_x:
                        return False
            t = self.last_merge.get(x)
            if t is None:
                return True
            x, until_x = t[0], self.rank[x]

    def _table(self, text: str) -> list[int]:
        """Ids of a run of known characters with at most one mark, by the table of prefixes."""
        size = len(text) + 1
        last, width = [0] * size, [0] * size
        #: by end position what is known of pairs with the prefix's last token
        row: list[dict[int, bool] | None] = [None] * size
        rows, done = self.pairs, 0
        for end, (token, n) in self.automaton.iter(text):
            stop = end + 1
            if stop == done:
                continue
            if n != stop:
                known = row[stop - n]
                if known is None:
                    continue
                fits = known.get(token)
                if fits is None:
                    fits = known[token] = self.compatible(last[stop - n], token)
                    self.n_pairs += 1
                if not fits:
                    continue
            last[stop], width[stop] = token, n
            found = rows.get(token)
            if found is None:
                found = rows[token] = {}
            row[stop] = found
            done = stop
        if self.n_pairs >= KNOWN_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        ids, at = [], size - 1
        while at:
            ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def _known(self, text: str) -> list[int]:
        if text.startswith(MARK + MARK):
            return self.merge(text)
        return self._table(text)

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a piece of text that no token reaches across the ends of."""
        found = self.units.get(text)
        if found is None:
            inner, cuts = self.inner, []
            for k in range(1, len(text)):
                if text[k - 1 : k + 1] not in inner:
                    cuts.append(k)
            if cuts:
                ids: list[int] = []
                for start, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
                    ids += self.units.get(text[start:end]) or self._whole(text[start:end])
                found = tuple(ids)
                if len(text) <= 64:
                    self._remember(text, found)
            else:
                found = self._whole(text)
        return found

    def _whole(self, text: str) -> tuple[int, ...]:
        """Ids of a run in which every neighbouring pair of characters is in some token, or of a single character."""
        if self.chars.issuperset(text):
            found = tuple(self._known(text))
        else:  # a character that is no token is in no pair of one, so it is alone here
            found = tuple(self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass"))
        if len(text) <= 64:
            self._remember(text, found)
        return found

    def _remember(self, text: str, ids: tuple[int, ...]) -> None:
        """Keep a word from its second sight on, so that words that come once leave room for others."""
        at = hash(text) & (len(self.met) - 1)
        if not self.met[at]:
            self.met[at] = 1
            self.n_met += 1
            if self.n_met > len(self.met) // 4:
                self.met, self.n_met = bytearray(len(self.met)), 0
            return
        if len(self.units) >= KNOWN_UNITS:
            self.units.clear()
        self.units[text] = ids

    def encode(self, text: str | None) -> list[int]:
        """Ids with begin and end."""
        out = [self.bos]
        if text:
            known, unit = self.units.get, self.unit
            for piece in self.split.findall(MARK + text.replace(" ", MARK)):
                out += known(piece) or unit(piece)
        out.append(self.eos)
        return out

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the leading mark's space goes, broken byte runs become U+FFFD a byte."""
        data = b"".join(map(self.texts.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if first is not None and self.pieces[first].startswith(MARK) and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _load(blob: bytes) -> PieceModel:
    return PieceModel(blob)


def load_model(path: str) -> bytes:
    """Bytes of a model file (the file is an input of the driver; its bytes are shipped to the tasks)."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, and ``decoded``) of every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # the vocabulary's file: about half a megabyte
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(shared.value)
        only_caches_of("sentencepiece", _load.cache_clear)
        for batch in batches:
            for start, texts in chunks(batch, "text"):
                n, a, b, all_ids, all_texts = [], [], [], [], []
                for text in texts:
                    ids = pieces.encode(text)
                    back = pieces.decode(ids)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                    if with_text:
                        all_texts.append(back)
                cols = [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    cols.append(pa.array(all_texts, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
