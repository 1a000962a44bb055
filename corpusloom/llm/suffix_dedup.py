"""Removal of long repeated byte strings by refining buckets of suffixes.

The suffixes that are sorted into buckets are those at anchors: of every string of `length`
bytes, the positions of its least q-gram (by hash). Equal strings have equal anchors at equal
places, and some 2 in 240 positions are anchors. The initial bucket of a suffix is its q-gram.
A round splits every bucket by what stands at further offsets on both sides of the anchor: a
new identifier is that of the bucket in the round before with the short strings next to it, so
each round reuses the identifiers that the round before has made, and reads no byte twice. An
identifier is a 128-bit hash in place of a pointer to its bucket's end, so that tasks agree on
it without one sorted array; a round is a count by identifier. A bucket of one suffix is
dropped, and suffixes alike as far as `length` reaches need no more rounds, but for one that
stays as witness for others. Strings with one identifier count as equal; their bytes are not
compared (at 10 ** 14 strings, some 1 in 10 ** 10 that any two identifiers meet by chance).

Passages of over 50 words may be shorter than `length` and are then never removed. They are
counted beside it by winnowing: the least 20-word string (by hash) of each 51 words is a
fingerprint of its document, so documents that share 51 words share a fingerprint, and those
that share no 20 words share none.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import by_number, free, remove, save, scratch, table

LENGTH = 400
#: A node is cut into so many at most, a round.
FAN = 7
#: Bytes whose grams are held at once; longer documents are read in tiles with a margin.
TILE = 1 << 20
#: Words of a string that fingerprints a document, and of a passage that is sure to hold one.
GRAM_WORDS, PASSAGE_WORDS = 20, 51
#: Bits of an offset in a node's number.
BITS = 10
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def gram_hash(data: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of the q bytes from each position (q at least 8), below 2 ** 32 - 1; too late positions are left out."""
    n = len(data) - 7
    if len(data) < q:
        return np.zeros(0, dtype=np.uint32)
    x = np.empty(n, dtype=np.uint64)
    for o in range(8):
        part = data[o : o + (len(data) - o) // 8 * 8].view("<u8")
        x[o::8] = part[: len(x[o::8])]
    have, level = 8, 0
    x *= _A[5]
    x ^= x >> np.uint64(32)
    while have < q:
        step = min(have, q - have)
        y = x[: len(x) - step] * _A[level % 4]
        y += x[step:]
        y *= _A[4]
        y ^= y >> np.uint64(29)
        x, have, level = y, have + step, level + 1
    return np.minimum((x >> np.uint64(32)).astype(np.uint32), np.uint32(0xFFFFFFFE))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, bounds: list[tuple[int, int]], length: int, q: int) -> np.ndarray:
    """(anchors, 3): position in data, first and last start of the strings of `length` bytes that have their least q-gram there.

    Strings lie within one of bounds (start, end).
    """
    w = length - q + 1
    if len(data) < length:
        return np.zeros((0, 3), dtype=np.int64)
    h = gram_hash(data, q)
    least = _sliding(h, w, np.minimum)
    whole = np.zeros(len(least), dtype=bool)
    for start, end in bounds:
        if end - start >= length:
            whole[start : end - length + 1] = True
    least = np.where(whole, least, np.uint32(0xFFFFFFFF))
    # Runs of starts with one least value; all anchors of a run hold that value.
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    value = least[first]
    first, last, value = (x[value != 0xFFFFFFFF] for x in (first, last, value))
    low = _sliding(np.concatenate([np.zeros(w - 1, np.uint32), np.where(whole, least, np.uint32(0)), np.zeros(w - 1, np.uint32)]), w, np.maximum)
    spots = np.flatnonzero(h == low[: len(h)])
    at, out = np.searchsorted(spots, first), []
    runs = np.arange(len(first))
    while len(runs):
        runs, at = runs[at < len(spots)], at[at < len(spots)]
        inside = spots[at] <= last[runs] + w - 1
        runs, at = runs[inside], at[inside]
        own = h[spots[at]] == value[runs]
        p, r = spots[at[own]], runs[own]
        out.append(np.stack([p, np.maximum(first[r], p - w + 1), np.minimum(last[r], p)], axis=1))
        at = at + 1
    found = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
    return found[found[:, 1] <= found[:, 2]]


def document_anchors(texts: list[bytes], length: int, q: int):
    """Yields (document, anchors in it) of each text that has any."""
    margin = 2 * length
    k = 0
    while k < len(texts):
        if len(texts[k]) > TILE:
            data, found = np.frombuffer(texts[k], dtype=np.uint8), []
            for at in range(0, len(data), TILE):
                low, high = max(0, at - margin), min(len(data), at + TILE + margin)
                p = anchors(data[low:high], [(0, high - low)], length, q) + low
                found.append(p[(p[:, 0] >= at) & (p[:, 0] < at + TILE)])
            yield k, np.concatenate(found)
            k += 1
            continue
        first, size = k, 0
        while k < len(texts) and len(texts[k]) <= TILE and size < TILE:
            size += len(texts[k])
            k += 1
        ends = np.cumsum([len(t) for t in texts[first:k]])
        starts = ends - [len(t) for t in texts[first:k]]
        p = anchors(np.frombuffer(b"".join(texts[first:k]), dtype=np.uint8), list(zip(starts.tolist(), ends.tolist(), strict=True)), length, q)
        p = p[np.argsort(p[:, 0], kind="stable")]
        doc = np.searchsorted(ends, p[:, 0], side="right")
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for own in np.split(np.arange(len(p)), cuts) if len(p) else []:
            d = int(doc[own[0]])
            yield first + d, p[own] - starts[d]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NUMBER = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    steps = np.ones((2, n), dtype=np.uint64)
    steps[0, 1:], steps[1, 1:] = _A[0], pow(int(_A[0]), -1, 1 << 64)
    return tuple(np.cumprod(steps, axis=1, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _A[4]
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    # The sum over a word's bytes of their number times a power by place; white space counts as 0.
    power, inverse = _powers(max(TILE + 1, len(raw)))
    sums = np.add.reduceat(_NUMBER[raw] * power[: len(raw)], starts)
    return starts, _mixed(sums * inverse[starts])


def _winnowed(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and fingerprints, each once a document: the least hash of GRAM_WORDS words in each PASSAGE_WORDS of one document."""
    if len(words) < PASSAGE_WORDS:
        return doc[:0], words[:0]
    have, h = 1, words
    while have < GRAM_WORDS:
        step = min(have, GRAM_WORDS - have)
        h = _mixed(h[: len(h) - step] * _A[have % 4] + h[step:])
        have += step
    width = PASSAGE_WORDS - GRAM_WORDS + 1
    least = np.where(doc[PASSAGE_WORDS - 1 :] == doc[: len(doc) - PASSAGE_WORDS + 1], _sliding(h, width, np.minimum), np.uint64(0))
    none = np.zeros(width - 1, dtype=np.uint64)
    spots = np.flatnonzero((h == _sliding(np.concatenate([none, least, none]), width, np.maximum)) & (h != 0))
    d, h = doc[spots], h[spots]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def passage_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of passages: numbers of texts and 64-bit hashes."""
    docs, prints, k = [], [], 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) <= TILE):
            size += len(texts[k]) + 1
            k += 1
        if size <= TILE:
            starts, words = _word_hashes(b" ".join(texts[first:k]))
            doc = first + np.searchsorted(np.cumsum([len(t) + 1 for t in texts[first:k]]), starts, side="right")
        else:
            # One long text, cut at white space.
            parts, at, text = [], 0, texts[first]
            while at < len(text):
                end = at + TILE
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
                parts.append(_word_hashes(text[at:end])[1])
                at = end
            words = np.concatenate(parts)
            doc = np.full(len(words), first)
        d, h = _winnowed(words, doc)
        docs.append(d)
        prints.append(h)
    return (np.concatenate(docs), np.concatenate(prints)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


#: A node is an anchor and a range of offsets of strings before it: anchor, first offset of its
#: place in the grid, first and last offset of its own strings, packed into one number; u: the
#: identifier of all that its own strings cover, c: of its bucket, what all strings there share.
NODE = "rid bigint, node bigint, u0 bigint, u1 bigint, c0 bigint, c1 bigint"
_MASK = (1 << BITS) - 1
_HEAD = struct.Struct("<HHH").pack
#: Bytes of texts that leave a task at once.
BYTES_AT_ONCE = 4 << 20


def _grid(width: int) -> list[int]:
    """Offsets that a node of each round spans; a round's nodes nest in the round's before."""
    steps = [width]
    while steps[-1] > 1:
        steps.append(-(-steps[-1] // FAN))
    return steps


def _last(i: int, steps: list[int]) -> int:
    """The last offset of the node of the last of steps that starts at offset i."""
    start, end = 0, steps[0] - 1
    for step in steps[1:]:
        start += (i - start) // step * step
        end = min(end, start + step - 1)
    return end


def _node_ids(text: bytes, wanted: list[tuple], length: int, digests: list[bytes], rows: list) -> None:
    """Appends nodes and their identifiers.

    wanted: anchor, the grid's first and last offset, own first and last, and of the bucket
    that the node is cut from its first and last offset and identifier. What the strings at
    offsets i1 to i2 share goes from a - i1 to a - i2 + length; it is what those of the wider
    bucket share, and a piece more on each side.
    """
    from xxhash import xxh3_128_digest

    for a, i1, i2, v1, v2, w1, w2, known in wanted:
        end = a + length
        c = xxh3_128_digest(_HEAD(i1, 0, 0) + known + text[a - i1 : a - w1] + text[end - w2 : end - i2])
        digests.append(xxh3_128_digest(_HEAD(i1, v1, v2) + c + text[a - v2 : a - i1] + text[end - i2 : end - v1]))
        digests.append(c)
        rows.append((((a << BITS | i1) << BITS | v1) << BITS) | v2)


def _columns(rows: list, digests: list[bytes]) -> list:
    import pyarrow as pa

    ids = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 4)
    return [pa.array(rows, pa.int64()), *(pa.array(ids[:, k]) for k in range(4))]


def _refine(nodes: DataFrame, last: bool, length: int, at: str) -> tuple[DataFrame, DataFrame | None]:
    """One round: the strings found twice, as spans, and the nodes to be cut further."""
    spark = nodes.sparkSession
    # Nodes with one identifier share their bucket's.
    newest = (F.max("rid").alias("rid"), F.max_by("node", "rid").alias("node"), F.min("c0").alias("c0"), F.min("c1").alias("c1"))
    classes = save(nodes.groupBy("u0", "u1").agg(F.count("*").alias("n"), *newest, F.max("witness").alias("witness")), f"{at}-classes")
    twice = classes.filter("n > 1").select("u0", "u1")
    anchor, v1, v2 = F.shiftright("node", 3 * BITS), F.shiftright("node", BITS).bitwiseAND(F.lit(_MASK)), F.col("node").bitwiseAND(F.lit(_MASK))
    marks = save(nodes.filter("not witness").join(twice, ["u0", "u1"]).select("rid", (anchor - v2).cast("int").alias("start"), (anchor - v1 + length).cast("int").alias("end")), f"{at}-marks")
    cut = None
    if not last:
        shared = save(classes.groupBy("c0", "c1").agg(F.sum("n").alias("every"), F.count("*").alias("kinds")).filter("every > 1").select("c0", "c1", "kinds"), f"{at}-shared")
        live = classes.join(shared, ["c0", "c1"]).filter("n = 1 or kinds > 1")
        cut = save(live.select("rid", "node", (F.col("witness") | (F.col("n") > 1)).alias("witness"), "c0", "c1"), f"{at}-cut")
        remove(spark, f"{at}-shared")
    remove(spark, f"{at}-classes")
    return marks, cut


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and n_passages.

    A byte of a text in UTF-8 is removed if a string of `length` bytes that covers it also
    starts anywhere else in the table, in the same document or another; strings never cross
    documents. n_passages is the number of fingerprints of its passages (see above) that another
    row has too: over 0 for a text that shares 51 words in a row, whatever their bytes, and 0 for
    one that shares no 20 words; nothing is removed by it. Null texts count as empty. Rows that repeat a doc_id and text are documents of
    their own and so repeat each other. Extra columns are ignored; an empty table gives no rows.
    """
    import xxhash  # noqa: F401  (fails here rather than on an executor)

    spark = docs.sparkSession
    q = max(8, 2 * length // 5)
    steps = _grid(length - q + 1)
    if length < 16 or steps[0] > _MASK:
        raise ValueError("length is from 16 to about 1700 bytes")
    base = scratch(spark, "repeats")

    def scan(batches):
        import pyarrow as pa
        import zstandard

        pack, none, rid = zstandard.ZstdCompressor(level=1).compress, pa.nulls, TaskContext.get().partitionId() << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                m = len(texts)
                rids = np.arange(rid, rid + m)
                rid += m
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array(rids), *(none(m, pa.int64()) for _ in range(5)), part.column("doc_id"), pa.array([pack(t) for t in texts], pa.binary())], names)
                d, prints = passage_prints(texts)
                m = len(d)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array([2] * m, pa.int32()), pa.array(rids[d]), none(m, pa.int64()), pa.array(prints.view(np.int64)), *(none(m, pa.int64()) for _ in range(4)), none(m, pa.binary())], names)
                owner, rows, digests = [], [], []
                for d, found in document_anchors(texts, length, q):
                    # The initial bucket: the q-gram at the anchor, what the strings at all offsets share.
                    _node_ids(texts[d], [(p, 0, steps[0] - 1, p - s2, p - s1, 0, length, b"") for p, s1, s2 in found.tolist()], length, digests, rows)
                    owner.append(np.full(len(found), rids[d]))
                if rows:
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(np.concatenate(owner)), *_columns(rows, digests), none(m, pa.int64()), none(m, pa.binary())], names)

    names = ["kind", *(c.split()[0] for c in NODE.split(", ")), "doc_id", "packed"]
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"kind int, {NODE}, doc_id bigint, packed binary")
    scanned = save(scanned, f"{base}-scan", "kind")
    rows = scanned.filter("kind = 0").select("rid", "doc_id", "packed")
    prints = scanned.filter("kind = 2").select("rid", F.col("u0").alias("print"))
    common = save(prints.groupBy("print").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).filter("a < b").select("print"), f"{base}-common")
    passages = save(prints.join(common, "print").groupBy("rid").agg(F.count("*").alias("n_passages")), f"{base}-passages")
    for p in ("scan/kind=2", "common"):
        remove(spark, f"{base}-{p}")
    free(spark)
    grams = scanned.filter("kind = 1").select(*names[1:7])
    met = save(grams.groupBy("c0", "c1").agg(F.count("*").alias("n")).filter("n > 1").select("c0", "c1"), f"{base}-met")
    nodes = save(grams.join(met, ["c0", "c1"]).select(*names[1:7], F.lit(False).alias("witness")), f"{base}-nodes0")
    texts = save(by_number(rows.select("rid", "packed"), "rid", nodes.select(F.col("rid").alias("row")), True), f"{base}-texts")
    for p in ("scan/kind=1", "met"):
        remove(spark, f"{base}-{p}")
    free(spark)

    marks: list[DataFrame] = []
    for level in range(len(steps)):
        found, cut = _refine(nodes, level == len(steps) - 1, length, f"{base}-{level}")
        marks.append(found)
        remove(spark, f"{base}-nodes{level}")
        free(spark)
        if cut is None:
            break

        def children(batches, upper=steps[: level + 1], step=steps[min(level + 1, len(steps) - 1)]):
            import pyarrow as pa
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    rows, digests, owner, seen = [], [], [], []
                    for rid, raw, own in zip(part.column("rid").to_pylist(), part.column("packed").to_pylist(), part.column("own").to_pylist(), strict=True):
                        text, before = unpack(raw), len(rows)
                        for n in own:
                            node, known = n["node"], struct.pack("<qq", n["c0"], n["c1"])
                            a, i1, v1, v2 = node >> 3 * BITS, node >> 2 * BITS & _MASK, node >> BITS & _MASK, node & _MASK
                            i2 = _last(i1, upper)
                            # Only the parts of the grid that hold strings of this anchor.
                            wanted = [(a, i, min(i + step - 1, i2), max(i, v1), min(i + step - 1, v2), i1, i2, known) for i in range(i1 + (v1 - i1) // step * step, v2 + 1, step)]
                            _node_ids(text, wanted, length, digests, rows)
                            seen += [n["witness"]] * len(wanted)
                        owner += [rid] * (len(rows) - before)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *_columns(rows, digests), pa.array(seen, pa.bool_())], [*names[1:7], "witness"])

        own = save(cut.groupBy("rid").agg(F.collect_list(F.struct("node", "witness", "c0", "c1")).alias("own")), f"{base}-own{level}")
        nodes = save(own.join(texts, "rid").select("rid", "packed", "own").mapInArrow(children, f"{NODE}, witness boolean"), f"{base}-nodes{level + 1}")
        for p in (f"{base}-own{level}", f"{base}-{level}-cut"):
            remove(spark, p)
        free(spark)

    every = marks[0]
    for m in marks[1:]:
        every = every.union(m)
    spans = every.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = save(spans.join(passages, "rid", "full_outer"), f"{base}-spans")
    for p in ("texts", "passages", *(f"{k}-marks" for k in range(len(marks)))):
        remove(spark, f"{base}-{p}")
    free(spark)

    def cut_out(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
        for batch in batches:
            out, size = [], 0
            for doc, raw, own, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "spans", "n_passages")), strict=True):
                kept, removed, runs, at, text = [], 0, 0, 0, unpack(raw)
                for s, e in sorted((x["start"], x["end"]) for x in own or ()):
                    if s > at or not runs:
                        kept.append(text[at:s])
                        runs += 1
                        at = s
                    if e > at:
                        removed, at = removed + e - at, e
                kept = b"".join(kept) + text[at:]
                out.append((doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept, shared or 0))
                size += len(kept)
                if size > BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)

    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages"]
    touched = spans.select(F.col("rid").alias("row"))
    cut = by_number(rows, "rid", touched, True).join(spans, "rid").select("doc_id", "packed", "spans", "n_passages")
    whole = by_number(rows, "rid", touched, False).select("doc_id", "packed", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(0).cast("long").alias("n_passages"))
    return cut.unionByName(whole).mapInArrow(cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, n_passages bigint")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and as text what is left, as a table of documents names it; a character of which only some bytes stay shows as U+FFFD there.

    n_passages counts what a text shares with others by words, also below 400 bytes.
    """
    found = repeated_bytes(table(spark, sf_dir, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
