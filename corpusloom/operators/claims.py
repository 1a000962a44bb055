"""Sentences, number tokens with their places, text similarity and consistency of stated numbers."""

from __future__ import annotations

import difflib
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import NUMBER

_NUMBER = re.compile(NUMBER)
TOKENS = T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("is_pct", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def sentences(text: Column) -> Column:
    """Cut after a closing sign, white space and before a capital or an opening sign."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z\"“(‘’])"), lambda x: x != "")


@F.pandas_udf(TOKENS)
def number_tokens(texts: pd.Series) -> pd.Series:
    """Numbers of each text with value, percent sign and place; Spark has no pattern function that gives places."""
    one = lambda t: [{"raw": m[0], "value": float(m[0].rstrip("%").replace(",", "")), "is_pct": m[0].endswith("%"), "start": m.start(), "end": m.end()} for m in _NUMBER.finditer(t or "")]
    return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio to four places; null if either text is."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b, strict=True)], index=a.index, dtype="float64")


# How reports state a count with its percentage. Groups: the count, the whole where it is stated, the percentage.
_N, _GAP, _OF = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?", r"(?:\s+\S+){0,5}?", r"\s+of\s+(?:the\s+)?"
SHAPES = {
    "of_whole_in_brackets": (rf"(?U)(?<!\d)({_N}){_OF}(?<!\d)({_N}){_GAP}\s*\(\s*(?<!\d)({_N})%\s*\)", True),
    "of_whole_after_comma": (rf"(?U)(?<!\d)({_N}){_OF}(?<!\d)({_N}){_GAP},\s*(?:or\s+)?(?<!\d)({_N})%", True),
    "of_total": (rf"(?U)(?<!\d)(?<!of )(?<!the )({_N})(?!\s+of\s+(?:the\s+)?\d){_GAP}\s*[(,]\s*(?<!\d)({_N})%", False),
}


def count_percent_mismatches(df: DataFrame, key: str, body: str, total: str, tolerance: float = 0.55) -> DataFrame:
    """Stated counts whose percentage is further than tolerance from the computed one: key, shape, n, whole, stated, actual.

    "n of m ... (p%)" and "n of m ..., p%" are held against 100 n / m, "n ... (p%)" and
    "n ..., p%" against 100 n / total. Rows whose total is null or not positive give none.
    """
    text, number = F.coalesce(F.col(body), F.lit("")), lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    groups = lambda p, *ks: [F.regexp_extract_all(text, F.lit(p), F.lit(k)) for k in ks]

    def finds(shape: str, pattern: str, states_whole: bool) -> Column:
        n, *whole, p = groups(pattern, 1, 2, 3) if states_whole else groups(pattern, 1, 2)
        whole = whole[0] if whole else F.transform(n, lambda _: F.col(total).cast("string"))
        return F.transform(F.arrays_zip(n.alias("n"), whole.alias("whole"), p.alias("p")), lambda x: F.struct(F.lit(shape).alias("shape"), x["n"].alias("n"), x["whole"].alias("whole"), x["p"].alias("p")))

    found = [finds(shape, *how) for shape, how in SHAPES.items()]
    rows = df.filter(F.col(total) > 0).select(key, F.explode(F.concat(*found)).alias("s"))
    rows = rows.select(key, "s.shape", number(F.col("s.n")).alias("n"), number(F.col("s.whole")).alias("whole"), number(F.col("s.p")).alias("stated")).filter("whole > 0")
    return rows.withColumn("actual", 100 * F.col("n") / F.col("whole")).filter(F.abs(F.col("stated") - F.col("actual")) > tolerance)


# How reports state the number of records; the count is group 1, of how many group 2 where it is told.
OUTCOMES = (r"(?i)Screening outcome:\s*([\d,]+)\s+of\s+([\d,]+)\s+URLs retained", r"Screening outcome:\s*([\d,]+)\s+of the\s+([\d,]+)\s+input URLs were retained")


def stated_outcome(text: Column) -> Column:
    """struct(retained, total) of the first phrasing that holds; null without any."""
    number = lambda k: F.coalesce(*[F.nullif(F.replace(F.regexp_extract(text, p, k), F.lit(","), F.lit("")), F.lit("")).try_cast("bigint") for p in OUTCOMES])
    return F.when(number(1).isNotNull(), F.struct(number(1).alias("retained"), number(2).alias("total")))


def stated_total(text: Column, noun: str) -> Column:
    """The count stated before noun (a pattern), or else that of a stated outcome."""
    first = F.replace(F.regexp_extract(text, rf"([\d,]+)\s+{noun}", 1), F.lit(","), F.lit(""))
    return F.coalesce(F.nullif(first, F.lit("")).try_cast("bigint"), stated_outcome(text)["retained"])


def bootstrap_ratio(df: DataFrame, cluster: str, part: str, whole: str, resamples: int = 10_000, seed: int = 20260812) -> tuple[float, float]:
    """Percentile interval (2.5, 97.5) of sum(part) / sum(whole) over resampled clusters.

    Clusters are first summed in Spark and alike ones counted together; a resample then draws
    a multinomial count of each kind, so the driver holds only distinct pairs of sums, of
    which there may be at most 100,000.
    """
    import numpy as np

    kinds = df.groupBy(cluster).agg(F.sum(part).alias("p"), F.sum(whole).alias("w")).groupBy("p", "w").agg(F.count("*").alias("n"))
    rows = kinds.limit(100_001).collect()
    if not rows or len(rows) > 100_000:
        raise ValueError(f"bootstrap_ratio: {len(rows)} kinds of clusters")
    rows.sort()
    p, w, n = (np.array([r[k] for r in rows], dtype=float) for k in ("p", "w", "n"))
    rng, out = np.random.default_rng(seed), []
    for _ in range(resamples):
        drawn = rng.multinomial(int(n.sum()), n / n.sum())
        out.append((drawn @ p) / (drawn @ w))
    return tuple(float(x) for x in np.percentile(out, [2.5, 97.5]))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring (array of struct x, y), by ray casting; rings without points hold none."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


# What tells that a name belongs to an organisation, that a clause ends, and that a share is meant as large.
_OF_A_NAME = re.compile(r"\b(?:de|di|del|della|du)\s+$", re.IGNORECASE)
_CLAUSE_ENDS = re.compile(r"\b(?:whereas|while|but|however|although|though)\b|[;—]", re.IGNORECASE)
_LARGE = re.compile(r"\b(majority|most|over half|nearly all)\b", re.IGNORECASE)
_ACCOUNT = r"account(?:s|ed|ing)?\s+for\s+"
_SHARE_OF_SUM = tuple(re.compile(p) for p in (rf"{_ACCOUNT}(?<!\d)({_N})%", rf"{_ACCOUNT}(?<!\d)(?:{_N}){_OF}(?<!\d)(?:{_N}){_GAP}\s*\(\s*(?<!\d)({_N})%\s*\)", rf"{_ACCOUNT}(?<!\d)(?:{_N}){_OF}(?<!\d)(?:{_N}){_GAP},\s*(?:or\s+)?(?<!\d)({_N})%"))
_NO_BASIS = re.compile(r"\bpopulation of\s+\d[\d,]*\.?\d*|\bper[\s-]capita\b|\bper\s+\d[\d,]*\.?\d*\s*(?:residents|people|inhabitants)\b|\bcensus(?:\s+(?:population|data))?\b", re.IGNORECASE)
_CAPITALS = re.compile(r"([A-Z][\w&'’.À-ſ-]*(?:\s+(?:and\s+|&\s+)?[A-Z0-9][\w&'’.À-ſ-]*){0,3})\s*(?:\(|,\s+(?:which\s+)?(?:alone\s+)?(?:accounts?\s+for|hosts?|contains?)\s+|\s+leading\s+at\s+)\s*(\d[\d,]*\.?\d*)")
_NO_NAMES = {"The", "This", "These", "Those", "Notably", "Yellow", "Green", "Red", "In", "No", "Among", "Comparing", "Green Districts", "Red Districts"}
#: Characters within which a number belongs to a name, to a word for a large share, and to a sum.
NAME_REACH, LARGE_REACH, SUM_REACH = 20, 60, 130


class Names:
    """Known names, as a pattern: longest first, and lists such as `Ward 3, 5 and 7` that say a numbered name's word once."""

    def __init__(self, names: list[str]):
        self.names = sorted(set(names), key=lambda n: (-len(n), n))
        whole = [re.escape(n) for n in self.names]
        words = sorted({m[1] for n in self.names if (m := re.fullmatch(r"(.+?)\s+\d+[A-Za-z]*", n))})
        runs = [re.escape(w) + r"\s+\d+[A-Za-z]*(?:\s*(?:,|and|&)\s*\d+[A-Za-z]*)+" for w in words]
        self.spans_of = re.compile(r"\b(?:" + "|".join(runs + whole) + r")\b") if whole else None

    def spans(self, sentence: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.spans_of.finditer(sentence)] if self.spans_of else []

    def numbers(self, sentence: str) -> list[tuple[int, int, float, bool, str]]:
        """(start, end, value, is_pct, raw) of the numbers that are no part of a name."""
        spans = self.spans(sentence)
        found = []
        for m in _NUMBER.finditer(sentence):
            if not any(a <= m.start() and m.end() <= b for a, b in spans):
                found.append((m.start(), m.end(), float(m[0].rstrip("%").replace(",", "")), m[0].endswith("%"), m[0]))
        return found

    def nearest(self, sentence: str, name: str) -> tuple | None:
        """The number nearest to an occurrence of name, NAME_REACH away at most and in its clause; none for an organisation's name."""
        near = []
        numbers = self.numbers(sentence)
        for order, m in enumerate(re.finditer(rf"\b{re.escape(name)}\b", sentence)):
            if _OF_A_NAME.search(sentence[: m.start()]):
                continue
            for k, n in enumerate(numbers):
                after = n[0] >= m.end()
                if not after and n[1] > m.start():
                    continue
                between = sentence[m.end() : n[0]] if after else sentence[n[1] : m.start()]
                a_year = not after and 1900 <= n[2] <= 2100 and len(n[4]) == 4 and not between.strip()
                if len(between) <= NAME_REACH and not a_year and not _CLAUSE_ENDS.search(between):
                    near.append((len(between), order, k))
        return numbers[min(near)[2]] if near else None


def _near_number(numbers: list[tuple], start: int, end: int, reach: int) -> tuple | None:
    away = [(n[0] - end if n[0] >= end else start - n[1], k) for k, n in enumerate(numbers) if n[0] >= end or n[1] <= start]
    away = [x for x in away if x[0] <= reach]
    return numbers[min(away)[1]] if away else None


def majority_flags(sentence: str, total: float | None, names: Names) -> list[str]:
    """Words for a large share whose nearest number is half of the total or less."""
    out = []
    for m in _LARGE.finditer(sentence) if total and total > 0 else ():
        n = _near_number(names.numbers(sentence), *m.span(), LARGE_REACH)
        if n and (share := n[2] if n[3] else 100 * n[2] / total) <= 50:
            out.append(f"{m[0]}: {n[4]} is {share:.2f}%")
    return out


def sum_flags(sentence: str, total: float | None, names: Names, tolerance: float = 0.55) -> list[str]:
    """Shares that listed counts are said to account for, further than tolerance from their sum's share of the total."""
    if not total or total <= 0:
        return []
    stated: dict[int, float] = {}
    for pattern in _SHARE_OF_SUM:
        for m in pattern.finditer(sentence):
            stated[m.start()] = min(stated.get(m.start(), float("inf")), float(m[1].replace(",", "")))
    out = []
    for start, share in sorted(stated.items()):
        counts = [n[2] for n in names.numbers(sentence[max(0, start - SUM_REACH) : start]) if not n[3]]
        if len(counts) >= 2 and abs(100 * sum(counts) / total - share) > tolerance:
            out.append(f"{'+'.join(f'{c:g}' for c in counts)} is {100 * sum(counts) / total:.2f}%, not {share:g}%")
    return out


def basis_flags(sentence: str, total: float | None, names: Names) -> list[str]:
    """Phrases that rest on figures which no source holds."""
    return [m[0] for m in _NO_BASIS.finditer(sentence)]


#: The checks of a sentence by name, all of one shape: (sentence, total, names) to details.
CHECKS = {"majority": majority_flags, "sum": sum_flags, "basis": basis_flags}


def consistency_flags(names: list[str], checks: dict = CHECKS):
    """A Column function (sentence, total) to the flags of all checks: array of (check, detail). names is configuration, a list of places."""

    @F.pandas_udf("array<struct<check:string,detail:string>>")
    def run(sentences_: pd.Series, totals: pd.Series) -> pd.Series:
        known = Names(names)
        one = lambda s, t: [{"check": c, "detail": x} for c, f in checks.items() for x in f(s or "", None if t is None or t != t else float(t), known)]
        return pd.Series([one(s, t) for s, t in zip(sentences_, totals, strict=True)], index=sentences_.index, dtype=object)

    return run


def numbers_outside_names(names: list[str]):
    """A Column function from text to the numbers in it that are no part of a known name (raw, value, is_pct, start, end)."""

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.Series:
        known = Names(names)
        one = lambda t: [{"raw": n[4], "value": n[2], "is_pct": n[3], "start": n[0], "end": n[1]} for n in known.numbers(t or "")]
        return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)

    return run


def numbers_by_name(names: list[str]):
    """A Column function from a sentence to the number nearest to each known name in it: array of (name, raw, value, is_pct)."""

    @F.pandas_udf("array<struct<name:string,raw:string,value:double,is_pct:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        known = Names(names)

        def one(t):
            hits = ((name, known.nearest(t, name)) for name in known.names if name in t)
            return [{"name": name, "raw": n[4], "value": n[2], "is_pct": n[3]} for name, n in hits if n]

        return pd.Series([one(t or "") for t in texts], index=texts.index, dtype=object)

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def capitalised_candidates(texts: pd.Series) -> pd.Series:
    """Capitalised names right before a number in brackets or a verb of holding, but for common first words."""
    one = lambda t: [n for m in _CAPITALS.finditer(t or "") if (n := m[1].strip()) not in _NO_NAMES and len(n) > 1]
    return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)


class _Sections(HTMLParser):
    """Paragraphs that stand beside an <h2>, under its heading, until the next."""

    VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
    #: An open paragraph ends where one of these begins.
    BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "section", "article"}

    def __init__(self):
        super().__init__()
        self.stack, self.found, self.level, self.heading, self.inside, self.parts = [], [], None, None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        if tag in self.BLOCK and "p" in self.stack:
            self.handle_endtag("p")
        if self.inside is None and tag == "h2":
            self.inside, self.parts = "h2", []
            self.level = len(self.stack)
        elif self.inside is None and tag == "p" and self.heading is not None and len(self.stack) == self.level:
            self.inside, self.parts = "p", []
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        if tag == self.inside:
            body = " ".join(" ".join(self.parts).split())
            if tag == "h2":
                self.heading = body
            else:
                self.found.append({"heading": self.heading, "para": body})
            self.inside = None

    def handle_data(self, data):
        if self.inside and data.strip():
            self.parts.append(data.strip())

    def close(self):
        super().close()
        if self.inside:
            self.handle_endtag(self.inside)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("para", T.StringType())])))
def sections(pages: pd.Series) -> pd.Series:
    """(heading, paragraph) of the paragraphs that follow each <h2> as its siblings; a page without <h2> has none."""

    def one(page):
        parser = _Sections()
        parser.feed(page or "")
        parser.close()
        return parser.found

    return pd.Series([one(p) for p in pages], index=pages.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("value", T.DoubleType())])))
def flat_facts(documents: pd.Series) -> pd.Series:
    """Numbers of a JSON object by dotted path, with the top-level key that holds them (`_scalar` for a bare number); booleans are none.

    List entries go by their own name, district, label, type or category where they have one, else by place.
    """

    def walk(value, path: str, group: str):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}", group)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                own = next((v[x] for x in ("name", "district", "label", "type", "category") if isinstance(v.get(x), str)), None) if isinstance(v, dict) else None
                yield from walk(v, f"{path}[{own or k}]", group)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            yield {"path": path, "grp": group, "value": float(value)}

    def one(text):
        facts = json.loads(text) if text else {}
        return [x for k, v in facts.items() for x in walk(v, k, k if isinstance(v, (dict, list)) else "_scalar")]

    return pd.Series([one(t) for t in documents], index=documents.index, dtype=object)


def fact_candidates(claims: DataFrame, facts: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """Claims (claim_id, value) with n_candidates, and slots: the shortest paths of facts (path, value) with that value, `most` at most, and how many more."""
    at = lambda c: F.round(F.col(c), 8)
    paths = facts.select(*by, at("value").alias("_at"), F.struct(F.length("path").alias("n"), "path").alias("p")).distinct()
    grouped = paths.groupBy(*by, "_at").agg(F.array_sort(F.collect_list("p")).alias("_paths"))
    joined = claims.withColumn("_at", at("value")).join(grouped, [*by, "_at"], "left")
    n = F.coalesce(F.size("_paths"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    shown = F.array_join(F.transform(F.slice("_paths", 1, most), lambda p: p["path"]), " | ")
    slots = F.when(n == 0, "").otherwise(F.concat(shown, F.when(n > most, F.concat(F.lit("  (+"), n - most, F.lit(" more)"))).otherwise("")))
    return joined.select(*claims.columns, n.cast("long").alias("n_candidates"), slots.alias("slots"))


def matched_errors(errors: DataFrame, flags: DataFrame, by: str) -> DataFrame:
    """errors (id, by, section, nums) with the first flag (flag_id, heading, flag_nums) of the same group whose heading holds the section and that shares a number; null without any."""
    f = flags.select(F.col(by).alias("_by"), "flag_id", "heading", F.explode("flag_nums").alias("_num"))
    e = errors.select("id", F.col(by).alias("_by"), "section", F.explode("nums").alias("_num"))
    hits = e.join(f, ["_by", "_num"]).filter(F.contains(F.lower(F.trim("heading")), F.lower(F.trim("section")))).groupBy("id").agg(F.min("flag_id").alias("flag_id"))
    return errors.join(hits, "id", "left")
