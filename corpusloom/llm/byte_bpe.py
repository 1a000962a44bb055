"""Byte-level BPE by monoid tree reduction: halves are encoded apart and joined by re-encoding what lies at the seam."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm._common import table
from corpusloom.llm.piece_cache import PartEncoder

NO_RANK = 1 << 62
#: Windows beyond this many bytes are merged with a heap.
LONG_BYTES = 32
#: Pairs of tokens, and encoded strings of up to MEMO_BYTES bytes, that an encoder remembers before it starts anew.
PAIR_CACHE, MEMO, MEMO_BYTES = 200_000, 300_000, 8
#: Parts of texts whose ids a worker remembers, from one batch to the next, before it starts anew.
PARTS = 400_000
#: Ids that decoding puts together at a leaf of its tree.
LEAF_IDS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class TreeBpe:
    """Encoder and decoder for a table of ranks (bytes to id, lower merges first).

    A string is halved down to single bytes, and neighbours are joined on the way up; an
    encoder remembers the joins of token pairs and the encodings of short strings.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs, self.known = ranks, {}, {}
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: Joins made, those whose seam was stable at once, and windows that had to grow.
        self.joins, self.clean, self.grown = 0, 0, 0

    def merge(self, text: bytes) -> list[int]:
        """The ids of text by merging pairs of least rank, leftmost first, with no halving: what is done to a window."""
        ranks = self.ranks
        if text in ranks:
            return [ranks[text]]
        if len(text) > LONG_BYTES:
            return self._merge_long(text)
        parts = [text[k : k + 1] for k in range(len(text))]
        rank, none = ranks.get, NO_RANK
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            k = pairs.index(best)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, text: bytes) -> list[int]:
        """merge with a heap over a linked list, for long windows."""
        ranks, n = self.ranks, len(text)
        end, after, before = list(range(1, n + 1)), [*range(1, n), -1], list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                r = ranks.get(text[k : end[after[k]]])
                if r is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or after[k] < 0 or end[after[k]] != stop:
                continue
            gone = after[k]
            alive[gone], end[k], after[k] = False, stop, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [ranks[text[k : end[k]]] for k in range(n) if alive[k]]

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens together."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether the pair a, b encodes to itself."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two decoded strings together.

        A window of tokens at the seam is encoded anew and grows until the tokens at its rim
        form stable pairs with their neighbours outside. All neighbouring pairs of the result
        are then stable, and a sequence is the encoding of its bytes exactly if they are.
        """
        if not left or not right:
            return left or right
        self.joins += 1
        new = self.pair(left[-1], right[0])
        if new == [left[-1], right[0]]:
            self.clean += 1
            return left + right
        wl = wr = 1
        while True:
            left_ok = wl >= len(left) or self.stable(left[-wl - 1], new[0])
            right_ok = wr >= len(right) or self.stable(new[-1], right[wr])
            if left_ok and right_ok:
                return left[:-wl] + new + right[wr:]
            self.grown += 1
            wl, wr = (wl if left_ok else min(2 * wl, len(left))), (wr if right_ok else min(2 * wr, len(right)))
            new = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-wl:] + right[:wr])))

    def encode(self, text: bytes) -> list[int]:
        """The ids of text; the list is not to be changed."""
        found = self.known.get(text)
        if found is not None:
            return found
        half = len(text) // 2
        found = self.join(self.encode(text[:half]), self.encode(text[half:])) if half else [self.ranks[text]] if text else []
        if len(text) <= MEMO_BYTES:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[text] = found
        return found

    def decode(self, ids) -> bytes:
        """The bytes of ids, put together up a tree of halves."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


assert array("I").itemsize == 4 and sys.byteorder == "little"
_coders: dict[tuple[str, str], tuple[TreeBpe, PartEncoder]] = {}


def coder(path: str, pattern: str) -> tuple[TreeBpe, PartEncoder]:
    """A worker's coder for a ranks file and a pattern, made once."""
    if (path, pattern) not in _coders:
        import regex

        tree, find = TreeBpe(load_ranks(path)), regex.compile(pattern).findall
        seen: dict[str, bytes] = {}

        def ids_of(group: list[str]) -> list[bytes]:
            out = []
            for part in group:
                ids = seen.get(part)
                if ids is None:
                    ids = array("I", [i for m in find(part) for i in tree.encode(m.encode())]).tobytes()
                    if len(part) <= 64:
                        if len(seen) >= PARTS:
                            seen.clear()
                        seen[part] = ids
                out.append(ids)
            return out

        _coders[path, pattern] = tree, PartEncoder(ids_of)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        _, encoder = coder(path, pattern)
        for part in batches:
            ids = encoder.texts(["" if t is None else t for t in part["text"]])
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [np.frombuffer(x, dtype="<u4").astype("int32") for x in ids]})

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, ids_sha256 of the ids in decimal, decoded_sha256 of the decoded bytes.

    A null text counts as empty: no ids, and the digests of no bytes. Rows that repeat are encoded
    each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tree, encoder = coder(path, pattern)
        for batch in batches:
            for part, encoded in encoder.batches(batch):
                n, ids_sha, out_sha = [], [], []
                for raw in encoded:
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    out_sha.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
