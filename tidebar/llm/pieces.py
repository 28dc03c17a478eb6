"""Exact SentencePiece merge-type encoding by backtracking.

A piece model of the merge type turns characters into pieces by always merging the adjacent pair whose union has
the best score, the leftmost of equals. Instead of replaying merges over a text, the encoder walks it once: at each
position it takes the longest piece that an Aho-Corasick automaton found there, accepts it if it is compatible
with the piece before it, and otherwise tries the next shorter piece, or steps back and marks the position
as failed in a bitfield so that it is not tried again. Two adjacent pieces are compatible if merging their
joined text again gives the same two pieces.

No piece has a blank mark behind another character, so merges never cross the border before a run of
blank marks; the text is cut there and repeated chunks are looked up. With a model that breaks this rule the
text is one chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
EMPTY = hashlib.sha256(b"").hexdigest()
CHUNK_CACHE = 300_000     # entries of each half of the caches of one Python worker


class Recent(dict):
    """Bounded memo of ``make``: when full it becomes the older half, and what is asked for again moves back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= CHUNK_CACHE:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if type(key) is int or len(key) <= 64:
            self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder for one model file; ``content`` is the file's bytes."""

    def __init__(self, content: bytes):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes_at, self.pieces, self.scores = {}, {}, {}
        self.shown: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.shown.append(b"")
            elif model.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                self.pieces[piece] = i
                self.scores[piece] = model.get_score(i)
                self.shown.append(piece.replace(MARK, " ").encode())
        # When a piece is made: characters are there from the start, a piece that no merging makes never is.
        self.split = {p: self.halves(p) for p in self.pieces if len(p) > 1}
        self.due = {p: -self.scores[p] if len(p) > 1 else -1 for p in self.pieces if len(p) == 1 or self.split[p]}
        self.names = {self.pieces[p]: p for p in self.due}
        self.shorter, self.length = [-1] * len(self.shown), [0] * len(self.shown)
        self.automaton = ahocorasick.Automaton()
        for p in self.due:
            i = self.pieces[p]
            self.length[i] = len(p)
            self.shorter[i] = next((self.pieces[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.due), -1)
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        # A chunk is a run of blanks and what follows it; a line feed outside the vocabulary stands alone too.
        feed = "" if "\n" in self.pieces else "\n"
        cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.cut = re.compile(f"[ {MARK}]*[^ {MARK}{feed}]+|[ {MARK}]+" + (f"|{feed}" if feed else "") if cuts else "(?s:.+)").findall
        # No merge crosses two neighbours that no piece has side by side.
        self.neighbours = {p[k:k + 2] for p in self.due for k in range(len(p) - 1)}
        self.known, self.parts, self.pairs = Recent(self.shown_chunk), Recent(self.run), Recent(self.compatible)

    def halves(self, text: str) -> tuple[str, str] | None:
        """The two pieces whose union is the last merge of ``text``; none if merging it does not end in one piece."""
        parts, right, left = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(-self.scores[text[i:i + 2]], i, text[i:i + 2]) for i in range(len(text) - 1) if text[i:i + 2] in self.scores]
        heapq.heapify(heap)
        last = None
        while heap:
            _, i, union = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != union:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j], right[i] = union, "", right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and (b := right[a]) < len(parts) and parts[a] + parts[b] in self.scores:
                    heapq.heappush(heap, (-self.scores[parts[a] + parts[b]], a, parts[a] + parts[b]))
        return last if last and last[0] + last[1] == text else None

    def compatible(self, pair: int) -> bool:
        """Whether merging the joined pair again (ids in the upper and lower 32 bits) leaves its two pieces as they are.

        Merges are undone backwards, the latest first. A union of the parts that meet at the border would have come
        first if it is due before the merge undone last; on a tie the left one wins.
        """
        due, split, before, tie = self.due, self.split, float("inf"), False
        a, b = self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]
        while True:
            when = due.get(a + b)
            if when is not None and (when < before or tie and when == before):
                return False
            if due[a] > due[b]:
                before, tie, a = due[a], False, split[a][1]
            elif due[b] >= 0:
                before, tie, b = due[b], True, split[b][0]
            else:
                return True

    def run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        longest = [-1] * (len(text) + 1)
        for end, (back, p) in self.automaton.iter(text):  # of one start, later ends are longer
            longest[end - back] = p
        pairs, shorter, length, goal = self.pairs, self.shorter, self.length, len(text)
        piece = longest[0]
        if length[piece] == goal:
            return [piece]
        failed, at, before = 0, 0, -1
        out: list[int] = []
        while at < goal:
            while piece >= 0:
                end = at + length[piece]
                if not failed >> end & 1 and (before < 0 or pairs[before << 32 | piece]):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, before, piece = end, piece, longest[end]
            elif out:
                failed |= 1 << at
                piece = out.pop()
                at -= length[piece]
                before, piece = out[-1] if out else -1, shorter[piece]
            else:
                raise ValueError("the vocabulary cannot spell the text")
        return out

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk; characters outside the vocabulary become their bytes."""
        out, start, text, near = [], 0, text.replace(" ", MARK), self.neighbours
        for k in range(1, len(text) + 1):
            if text[k - 1:k + 1] not in near:
                part = text[start:k]
                out += self.parts[part] if k - start > 1 or part in self.pieces else [self.bytes_at[b] for b in part.encode()]
                start = k
        return out

    def shown_chunk(self, text: str) -> tuple[str, bytes]:
        """Ids of a chunk as text, and what they decode to."""
        ids = self.chunk(text)
        return ",".join(map(str, ids)), b"".join(map(self.shown.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end ids. An empty text has none."""
        return [i for c in self.cut(" " + text) for i in self.chunk(c)] if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the blank put before a text when it was encoded goes."""
        joined = b"".join(map(self.shown.__getitem__, ids))
        return joined.removeprefix(b" ").decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        if not text:
            return 0, EMPTY, EMPTY
        known = self.known
        rows = [known[c] for c in self.cut(" " + text)]
        ids = ",".join([r[0] for r in rows])
        decoded = b"".join([r[1] for r in rows]).removeprefix(b" ").decode("utf-8", "replace")
        return ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codec: dict[str, PieceCodec] = {}


def _at_worker(name: str, content: bytes) -> PieceCodec:
    if name not in _codec:
        _codec.clear()
        _codec[name] = PieceCodec(content)
    return _codec[name]


def model_content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """Columns of ``docs`` plus ids array<int>. Null text: no ids."""
    content = docs.sparkSession.sparkContext.broadcast(model_content(model_path))
    from pyspark.sql import functions as F
    import pandas as pd

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = _at_worker(model_path, content.value)
        return texts.map(lambda t: codec.encode(t or ""))

    return docs.withColumn("ids", ids("text"))


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, one row per row of ``docs``.

    Null text counts as empty: no ids, digests of the empty string. Rows that repeat are kept as they are. The
    model file (half a MB) is read by the driver and broadcast, so executors need no copy.
    """
    content = docs.sparkSession.sparkContext.broadcast(model_content(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _at_worker(model_path, content.value)
        for batch in batches:
            rows = [codec.digest(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
