"""Codes of vectors: product quantisation in whole numbers, entries screened by float32 products with error intervals."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import save, scratch, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole components lie below this, so that squared distances over a whole vector fit 64 bits.
BOUND = 1 << 26
#: Unit roundoff of float32.
UNIT = 2.0**-24
#: Vectors that are compared at once.
ROWS_AT_ONCE = 8192
#: Label sums up to this number are sent to all tasks.
MOST_SENT_LABELS = 100_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The index in book (int64 rows) of the entry nearest to each row of x (int64), ties to the lower; and how many were compared exactly.

    |c|^2 - 2 x.c is taken from a float32 matrix product. That product, its arguments' rounding
    included, is off by at most g |x| |c| with g = m u / (1 - m u), whatever the order of its
    sums (m: two more than the terms). Entries whose interval overlaps the least upper end are
    compared again in int64; where one entry alone is left, it is the nearest.
    """
    m = (x.shape[1] + 2) * UNIT
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    squares = (book * book).sum(axis=1)
    size = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares.astype(np.float64))[None, :]
    # Beside the product, the float64 steps here are off by a few units of their last place.
    off = 2 * m / (1 - m) * size * (1 + 1e-9) + 1e-14 * (squares + 2 * np.abs(product)) + 1e-6
    screened = squares - 2 * product
    open_ = screened - off <= (screened + off).min(axis=1, keepdims=True)
    best, several = open_.argmax(axis=1), np.flatnonzero(open_.sum(axis=1) > 1)
    row, entry = np.nonzero(open_[several])
    if len(row):
        distance = np.full((len(several), len(book)), np.iinfo(np.int64).max)
        apart = x[several[row]] - book[entry]
        distance[row, entry] = (apart * apart).sum(axis=1)
        best[several] = distance.argmin(axis=1)
    return best, len(row)


def _whole(vector: str):
    """Batches of vectors as batches of their scaled floors, int32, without those that take no part."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(vector).cast(pa.list_(pa.float64()))
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False))
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            n = np.where(there, n, 0)
            at = np.repeat(np.arange(len(n)), n)
            keep = there & (n > 0)
            keep[at[~np.isfinite(flat.to_numpy(zero_copy_only=False))]] = False
            inside = keep[at]
            if (np.abs(x[inside]) >= BOUND).any():
                raise ValueError(f"a component beyond {BOUND // SCALE} has no code, as its squared distance may not fit 64 bits")
            rows = np.flatnonzero(keep)
            values = x[inside].astype("<i4")
            ends = np.cumsum(n[rows])
            cells = [values[e - k : e].tobytes() for e, k in zip(ends.tolist(), n[rows].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)), pa.array(cells, pa.binary())], ["vec_id", "label", "whole"])

    return run


def _matrix(column) -> np.ndarray:
    """int64 rows of a batch's binary column."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype="<i4").reshape(len(cells), -1).astype(np.int64)


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _sums(books: list[np.ndarray]):
    """Batches of vectors as one batch a task: part, entry, place, sum and n of the parts that are nearest to each entry."""

    def run(batches):
        import pyarrow as pa

        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                for p, x in enumerate(_parts(_matrix(batch.column("whole").slice(k, ROWS_AT_ONCE)), len(books))):
                    entry, _ = nearest(x, books[p])
                    np.add.at(total[p], entry, x)
                    count[p] += np.bincount(entry, minlength=len(books[p]))
        part, entry, place = np.indices((len(books), *books[0].shape)).reshape(3, -1)
        columns = [part, entry, place, np.concatenate([t.ravel() for t in total]), np.repeat(np.concatenate(count), books[0].shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "total", "n"])

    return run


def _coded(books: list[np.ndarray]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(k, ROWS_AT_ONCE)
                code, error = np.zeros((b.num_rows, len(books)), dtype=np.uint8), np.zeros(b.num_rows, dtype=np.int64)
                for p, x in enumerate(_parts(_matrix(b.column("whole")), len(books))):
                    code[:, p], _ = nearest(x, books[p])
                    apart = x - books[p][code[:, p]]
                    error += (apart * apart).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and whole (little-endian int32 of floor(4096 x)) of the rows that take part, written.

    Rows go whose vector is null, empty, or holds null or non-finite components. A component of
    16384 or more in size is an error.
    """
    spark, label = vectors.sparkSession, vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector)
    return save(rows.mapInArrow(_whole(vector), f"vec_id long, label {label}, whole binary"), scratch(spark, "vectors"))


def fit_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position: the parts of the smallest vec_ids, moved to the floors of their parts' means in each round.

    Every round reads all vectors. A task sends one row for each component of the codebooks,
    and the driver takes their sums, parts * entries * length numbers. Of equal vec_ids, those
    with lesser bytes come first, null ids last; fewer vectors than entries give fewer entries.
    Vectors must be of one length that the number of parts divides.
    """
    lengths = [r["n"] for r in whole.select(F.length("whole").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1 or any(n % (4 * parts) for n in lengths):
        raise ValueError(f"vectors must be of one length that {parts} divides")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    if not first:
        return []
    start = np.stack([np.frombuffer(r["whole"], dtype="<i4").astype(np.int64) for r in first])
    books = [b.copy() for b in _parts(start, parts)]
    for _ in range(rounds):
        sums = whole.select("whole").mapInArrow(_sums(books), "part long, entry long, place long, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.filter("n > 0").collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors' sum over equal labels; a few labels are sent to all tasks, more are joined."""
    sums = save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), scratch(coded.sparkSession, "label-errors"))
    sent = F.broadcast(sums) if sums.count() <= MOST_SENT_LABELS else sums
    of = sent.withColumnRenamed("label", "_label")
    return coded.join(of, coded["label"].eqNullSafe(of["_label"])).drop("_label")


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of each vector that takes part, and the codebooks.

    code: the index of the nearest entry of each part, two hex digits each; error: the squared
    distance between the vector and what its code stands for, in units of a 4096th; ties go to
    the lower index. Rows that repeat a vec_id are vectors of their own; null labels are one
    label; other columns are ignored; an empty table gives no rows and no codebooks. Which rows
    take part: see whole_vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    whole = whole_vectors(vectors, vector)
    books = fit_codebooks(whole, parts, entries, rounds)
    label = whole.schema["label"].dataType.simpleString()
    coded = save(whole.mapInArrow(_coded(books), f"vec_id long, label {label}, code string, error long"), scratch(whole.sparkSession, "codes"))
    return _with_label_error(coded), books


def decompress(codes: Column, books: list[np.ndarray]) -> Column:
    """The vector of doubles that a code stands for: the middles of its entries' components."""
    entries = [F.array(*[F.array(*[F.lit((v + 0.5) / SCALE) for v in row]) for row in b.tolist()]) for b in books]
    index = lambda p: F.conv(F.substring(codes, 2 * p + 1, 2), 16, 10).cast("int") + 1
    return F.concat(*[F.element_at(e, index(p)) for p, e in enumerate(entries)])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds as steps of one query, over rows (vec_id, part, its components) and entries (part, entry, its components)."""
    apart = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM kept, range({PARTS}) AS r(part))",
        f"book0 AS MATERIALIZED (SELECT part, (rank() OVER (PARTITION BY part ORDER BY vec_id)) - 1 AS entry, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, p.x, min(struct_pack(d := {apart}::BIGINT, entry := c.entry)) AS best FROM parts p JOIN book{k} c ON c.part = p.part GROUP BY ALL)")
        if k < ROUNDS:
            moved = f"SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM (SELECT part, best.entry AS entry, place, sum(x[place])::BIGINT AS s, count(*)::BIGINT AS n FROM near{k}, range(1, (SELECT len(x) FROM book0 LIMIT 1) + 1) AS r(place) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN ({moved}) m ON m.part = b.part AND m.entry = b.entry)")
    steps.append(f"codes AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id, label)")
    digest = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM codes"


OP12_SQL = _sql()
