"""Byte-level BPE encoding and decoding with a segment tree per piece.

A text is cut by the vocabulary's pattern; every match (piece) is merged separately. The leaves of a piece's segment
tree are its byte positions: a leaf holds the rank of the pair formed by the token that starts there and the next live
token, an inner node the smallest leaf below it. Ranks and positions are packed into one integer, so the root names the
leftmost pair of least rank. A merge links the pair's neighbours and updates three leaves: the merged token's, the
swallowed token's and the left neighbour's, each in a logarithmic number of steps.

Pieces are short and there are many, so the trees of all new pieces of a batch are worked on together, one merge per
tree and round, as rows of numpy arrays; long pieces run by themselves. Finished pieces are remembered per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rateweave.llm.common import worker_cache

LARGEST_FILE = 64_000_000
#: Entries that a worker remembers per kind before it starts anew; about 200 bytes each.
REMEMBERED = 600_000
#: Longer pieces are merged one at a time.
LONG_PIECE = 128
NONE = np.int64(1) << 62
#: What the regex module calls a letter or number and Unicode 16, which the rank files' library follows,
#: does not (yet).
LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""


def compiled(pattern: str):
    """The pattern with letters and numbers as in Unicode 16."""
    import regex

    later = "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in LATER.split())
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{later}]]")
    return regex.compile(pattern, regex.V1)


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes, for a broadcast; refuses files that are too large for one."""
    with open(path, "rb") as f:
        data = f.read(LARGEST_FILE + 1)
    if len(data) > LARGEST_FILE:
        raise ValueError(f"{path} has more than {LARGEST_FILE} bytes")
    return data


class Codec:
    """Encoder and decoder of one rank file (lines of base64 token and rank; the rank is the id)."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.pieces = compiled(pattern).findall
        # A piece never crosses a place before a space that something visible follows, whatever precedes it.
        self.chunks = re.compile(r" (?=\S)").split
        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_rank = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.piece_ids: dict[str, np.ndarray] = {}
        self.chunk_ids: tuple[dict, dict] = ({}, {})  # at the start of a text, after a space

    # --- encoding ---

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text as 32-bit integers."""
        cut = [self.chunks(text) for text in texts]
        first, later = self.chunk_ids
        if len(first) + len(later) > REMEMBERED:
            first.clear()
            later.clear()
        self._learn(first, {c[0] for c in cut}, "")
        self._learn(later, set().union(*(c[1:] for c in cut)), " ")
        return [np.frombuffer(first[c[0]] + b"".join(map(later.__getitem__, c[1:])), np.int32) for c in cut]

    def _learn(self, known: dict, chunks: set, before: str) -> None:
        new = [c for c in chunks if c not in known]
        pieces = [self.pieces(before + c) for c in new]
        if len(self.piece_ids) > REMEMBERED:
            self.piece_ids.clear()
        ids = self.piece_ids
        unseen = list(dict.fromkeys(p for ps in pieces for p in ps if p not in ids))
        ids.update(zip(unseen, self.merge([p.encode() for p in unseen])))
        for c, ps in zip(new, pieces):
            known[c] = b"".join(ids[p] for p in ps)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece (32-bit, as bytes), merged separately."""
        out: list[bytes] = [b""] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.int32(whole).tobytes()
            elif len(piece) > LONG_PIECE:
                out[i] = np.array(self._merge_long(piece), np.int32).tobytes()
            elif piece:
                rows.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in rows.items():
            most = max(1, 1_000_000 // width)
            for at in range(0, len(members), most):
                part = members[at:at + most]
                for i, ids in zip(part, self._merge_many([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where a pair is no token."""
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes, a power of two, all at once: a row each, one merge per round and row."""
        count, shift = len(pieces), np.int64(width.bit_length())
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        place = np.arange(width)
        live = np.zeros((count, width + 1), bool)
        live[:, :width] = place < lengths[:, None]
        token = np.zeros((count, width + 1), np.int64)
        token[:, :width] = self.byte_ids[flat]
        # neighbours by position; ``width`` stands for none
        after = np.full((count, width + 1), width)
        after[:, :width] = np.where(place + 1 < lengths[:, None], place + 1, width)
        before = np.full((count, width + 1), width)
        before[:, 1:width] = place[:-1]

        def packed(rank, position):
            return np.where(rank < NONE, (rank << shift) | position, NONE)

        tree = np.full((count, 2 * width), NONE)
        if width > 1:
            paired = place[:-1] + 1 < lengths[:, None]
            rank = np.where(paired, self._rank(token[:, :width - 1], token[:, 1:width]), NONE)
            tree[:, width:2 * width - 1] = packed(rank, place[:-1])
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(row, position, value):
            node = position + width
            tree[row, node] = value
            while width > 1 and node[0] > 1:  # all rows climb the same number of levels
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(count)
        while True:
            row = row[tree[row, 1] < NONE]
            if not len(row):
                break
            best = tree[row, 1]
            at, merged = best & ((np.int64(1) << shift) - 1), best >> shift
            gone = after[row, at]
            right = after[row, gone]
            left = before[row, at]
            token[row, at] = merged
            live[row, gone] = False
            after[row, at] = right
            before[row, right] = at
            put(row, gone, NONE)
            put(row, at, packed(np.where(right < width, self._rank(merged, token[row, right]), NONE), at))
            has = left < width
            if has.any():
                some, beside = row[has], left[has]
                put(some, beside, packed(self._rank(token[some, beside], merged[has]), beside))
        kept = live[:, :width]
        ids = token[:, :width][kept].astype(np.int32).tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        starts = np.r_[0, ends[:-1]]
        return [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one piece, in plain integers."""
        size = len(piece)
        width = 1 << (size - 1).bit_length()
        none, rank_of, bits = int(NONE), self.pair_rank.get, width.bit_length()
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))

        def leaf(a, b):
            rank = rank_of(token[a] << 32 | token[b])
            return none if rank is None else rank << bits | a

        tree = [none] * (2 * width)
        for i in range(size - 1):
            tree[width + i] = leaf(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(position, value):
            node = position + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            at, merged = tree[1] & ((1 << bits) - 1), tree[1] >> bits
            gone = after[at]
            right = after[gone]
            token[at], token[gone] = merged, -1
            after[at] = right
            put(gone, none)
            if right < size:
                before[right] = at
                put(at, leaf(at, right))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return [t for t in token if t >= 0]

    # --- decoding ---

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(vocabulary, pattern: str) -> Codec:
    """The worker's codec, made at its first use."""
    data = vocabulary.value
    name = f"bpe_{hashlib.md5(data + pattern.encode()).hexdigest()}"
    return worker_cache(name, lambda: Codec(data, pattern))


def _parts(batches, most_chars: int = 4_000_000):
    """Lists of (key, text) of bounded size; a longer text makes a list of its own."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        part, held = [], 0
        for key, text in zip(keys, texts):
            text = text.as_py() or ""
            part.append((key, text))
            held += len(text)
            if held >= most_chars:
                yield part
                part, held = [], 0
        if part:
            yield part


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` for every row of ``docs``.

    A null text is an empty one and has no ids. Special tokens are ordinary text. Rows do not influence each other, so
    null, tied or repeated keys come out as they went in; an empty table gives an empty table; other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(vocabulary, pattern)
        for part in _parts(batches):
            ids = codec.encode([t for _, t in part])
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], arrow_type(kind)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(encodings: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``(key, data binary)`` from ``(key, ids)``; null ids count as none."""
    vocabulary = encodings.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = encodings.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            data = [codec.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[key, "data"])

    return encodings.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row and keep digests: ``(key, n_tokens, ids_sha256, decoded_sha256)``.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the bytes that the ids decode to.
    Both steps run in one pass, so that ids need not travel. Nulls and repeats as in :func:`encoded`.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(vocabulary, pattern)
        decimal = worker_cache("decimals", lambda: [str(i) for i in range(1 << 17)])

        def digests(ids):
            ids = ids.tolist()
            listed = ",".join(map(decimal.__getitem__, ids) if not ids or max(ids) < len(decimal) else map(str, ids))
            return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        for part in _parts(batches):
            found = [digests(ids) for ids in codec.encode([t for _, t in part])]
            counts, listed, data = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], arrow_type(kind)), pa.array(counts, pa.int64()), pa.array(listed), pa.array(data)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of a key column."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
