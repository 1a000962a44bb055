"""Groups of spelling variants: words one edit apart, met by equal halves (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import remove, save, scratch, table

LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO = "A-Za-zÀ-ÿ", 7, 2, 10
#: One run of letters in so many loses a letter, by the checksum of its document and itself.
LOST_ONE_IN = 31
#: Words of a bucket; a larger one is cut again by the halves of what its words don't share yet.
BUCKET = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _at(word: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of word."""
    return F.substring(word, start + 1, end - start)


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, lost_one_in: int = LOST_ONE_IN) -> DataFrame:
    """word of each run of letters in docs (doc_id, text) that has least_length code points or more after its letter is lost.

    Runs are maximal, and A-Z alone is lower-cased. With h the crc32 of `<doc_id>:<run>`, a run
    whose h lost_one_in divides loses the code point h % length. Null texts have no runs; a null
    doc_id is written as nothing; rows that repeat an id are documents of their own.
    """
    # A shorter run can't be a word, as runs only lose letters.
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(_at(F.col("run"), F.lit(0), place), _at(F.col("run"), place + 1, F.length("run")))
    word = F.when(F.col("h") % lost_one_in == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length)


def _in_buckets(rows: DataFrame) -> DataFrame:
    """rows (word, n, length, longer, low, high) with `fixed`: the word but for [low, high), where a longer word has one code point more."""
    extra = F.col("longer").cast("int")
    return rows.withColumn("fixed", F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("|"), _at(F.col("word"), F.col("high") + extra, F.col("length") + extra)))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of [low, high) fixed beside what is, and with the second."""
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    open_ = F.array(F.struct(middle.alias("low"), F.col("high")), F.struct(F.col("low"), middle.alias("high")))
    cut = rows.select("word", "n", "length", "longer", F.explode(open_).alias("open"))
    return _in_buckets(cut.select("word", "n", "length", "longer", "open.low", "open.high"))


BUCKET_KEY = ["length", "low", "high", "fixed"]


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, near, near_n) for each ordered pair of words (word, n; distinct) that differ by one edit.

    Words are cut into two halves by their length; one edit leaves one of them as it is, so a
    word meets those of its length with an equal half, and those longer by one with an equal
    first half or an equal, shifted second half. A bucket of more than `bucket` words is cut
    again in the same way: of the half that may differ, one half is equal again. That ends at a
    single open code point, where a bucket holds no more words than there are letters, and
    longer ones than their square. A pair is taken in the bucket that holds its first
    difference, so it comes once. Words of no code points have no halves and no partners.
    """
    spark, at = words.sparkSession, scratch(words.sparkSession, "spelling")
    sides = F.array(F.struct(F.length("word").alias("length"), F.lit(False).alias("longer")), F.struct((F.length("word") - 1).alias("length"), F.lit(True).alias("longer")))
    rows = words.filter(F.length("word") > 0).select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.length", "side.longer").filter("length > 0")
    rows = _halves(rows.withColumns({"low": F.lit(0), "high": F.col("length")}))
    ready, paths = None, []
    while True:
        paths.append(f"{at}-{len(paths)}")
        rows = save(rows, f"{paths[-1]}-rows")
        sizes = rows.groupBy(*BUCKET_KEY).agg(F.count("*").alias("size"), F.count(F.when(~F.col("longer"), 1)).alias("own")).filter("size > 1 AND own > 0")
        met = save(rows.join(sizes.drop("own"), BUCKET_KEY), f"{paths[-1]}-met")
        remove(spark, f"{paths[-1]}-rows")
        crowded = (F.col("size") > bucket) & (F.col("high") - F.col("low") > 1)
        part = met.filter(~crowded).drop("size")
        ready = part if ready is None else ready.unionByName(part)
        more = met.filter(crowded).drop("size", "fixed")
        if more.isEmpty():
            break
        rows = _halves(more)
    own = ready.filter(~F.col("longer")).drop("longer")
    other = ready.select(*BUCKET_KEY, "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = own.join(other, BUCKET_KEY).filter("word <> near")
    a = _at(F.col("word"), F.col("low"), F.col("high"))
    b = _at(F.col("near"), F.col("low"), F.col("high") + F.col("longer").cast("int"))
    # A longer word whose open part starts with the other's differs at or after high: it is met in a later bucket, if there is one.
    first_here = ~F.col("longer") | (F.col("high") == F.col("length")) | ~F.startswith(b, a)
    pairs = met.filter((F.levenshtein(a, b, 1) == 1) & first_here).select("word", "n", "near", "near_n", "longer")
    both = F.when(F.col("longer"), F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    pairs = pairs.select(F.explode(F.coalesce(both, F.array(F.struct("word", "near", "near_n")))).alias("p")).select("p.*")
    out = save(pairs, f"{at}-pairs")
    for p in paths:
        remove(spark, f"{p}-met")
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): root is where the forms lead. A form is more frequent than its word, so none leads back."""
    spark, at = forms.sparkSession, scratch(forms.sparkSession, "spelling-roots")
    now, k = save(forms.select("word", F.col("form").alias("root")), f"{at}-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # Each round doubles the way that a root stands for.
        longer = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        k += 1
        longer = save(longer, f"{at}-{k}")
        remove(spark, f"{at}-{k - 1}")
        now = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, lost_one_in: int = LOST_ONE_IN, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs (doc_id, text) that occurs least_count times or more.

    n_near: how many words differ by one inserted, deleted or replaced code point. form: of
    those the most frequent (of equals the least in code-point order), if its count is ratio
    times n or more. root: where forms lead, the word itself if it has none. How words come of
    texts, nulls and repeated rows: see words_of. Other columns are ignored; an empty table
    gives no rows.
    """
    at = scratch(docs.sparkSession, "spelling-words")
    words = words_of(docs, least_length, lost_one_in).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    words = save(words, at)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    stats = near_pairs(words, bucket).groupBy("word").agg(F.count("*").alias("n_near"), best)
    stats = words.join(stats, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("n"))).alias("to"))
    stats = save(stats.select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n")), f"{at}-stats")
    roots = _roots(stats.filter("form IS NOT NULL").select("word", "form"))
    return stats.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


_BYTES = "list_transform(range(0, (length(hex(doc_id || ':' || run)) // 2)::BIGINT), lambda i: ('0x' || substr(hex(doc_id || ':' || run), (2 * i + 1)::BIGINT, 2))::BIGINT)"
#: crc32 by its table of 256 remainders; near words by masks and deletions of each place.
OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(0, 256) AS r(b)),
steps AS (SELECT list(c ORDER BY b) AS t FROM bits),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
checked AS (SELECT run, n, xor(list_reduce({_BYTES}, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM counted, steps),
lost AS (SELECT CASE WHEN h % {LOST_ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM checked),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM words, range(0, 100000) AS r(i) WHERE i < length(word)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM places a JOIN places b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT w.word, p.word, p.n FROM places p JOIN words w ON w.word = p.head || p.tail
  UNION SELECT p.word, w.word, w.n FROM places p JOIN words w ON w.word = p.head || p.tail),
stats AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(less := -near_n, near := near)) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= {RATIO} * w.n THEN best.near END AS form, CASE WHEN -best.less >= {RATIO} * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN stats s ON s.word = w.word),
ways AS (SELECT word, word AS root FROM formed UNION ALL SELECT y.word, f.form FROM ways y JOIN formed f ON f.word = y.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN ways y ON y.word = f.word JOIN formed e ON e.word = y.root AND e.form IS NULL
"""
