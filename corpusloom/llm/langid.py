"""Language identification by cross-parsing: the language whose suffix automaton parses a text in the fewest phrases."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import table, unused

#: The bound of the training sample: characters over all languages, and at most so many a language.
SAMPLE_CHARS, SAMPLE_CHARS_A_LANGUAGE = 160_000, 40_000
#: Of each language, this many documents at most lend text to the sample.
SAMPLE_DOCUMENTS = 128
#: Codes below this have a column of the table of transitions; rarer letters' transitions are held one by one.
ALPHABET = 96
#: Texts are parsed in segments of this many characters, each from the automaton's start.
SEGMENT = 512
UNDETERMINED = "und"

_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters than letters is one 0."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[cps]
    cps = np.where(letter, cps, 0)
    keep = letter.copy()
    keep[:1] |= True
    keep[1:] |= letter[:-1]
    return cps[keep]


class _Sparse(dict):
    """Transitions of a state by code; others lead to 0."""

    def __missing__(self, code):
        return 0


def suffix_automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """Transitions (states, width) of the suffix automaton of codes below width; 0 is both the start and no transition."""
    return _automaton(codes, width)[0]


def _automaton(codes: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The suffix automaton of codes: a table (states, width) for codes below width, and (state, code, next) for the rest."""
    size = 2 * len(codes) + 2
    go, link, longest = np.zeros((size, width), dtype=np.int32), [-1] * size, [0] * size
    rows = [go[k] for k in range(size)]
    more = [_Sparse() for _ in range(size)] if (codes >= width).any() else []
    dense = rows
    last, n = 0, 1
    for c in codes.tolist():
        rows = dense if c < width else more
        new = n
        n += 1
        longest[new] = longest[last] + 1
        p = last
        while p != -1 and not rows[p][c]:
            rows[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = int(rows[p][c])
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = n
                n += 1
                dense[twin][:] = dense[q]
                if more:
                    more[twin].update(more[q])
                longest[twin], link[twin] = longest[p] + 1, link[q]
                while p != -1 and rows[p][c] == q:
                    rows[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go[:n].copy(), [(k, c, to) for k, row in enumerate(more[:n]) for c, to in row.items()]


class CrossParser:
    """Automata of the sample texts of each language."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        coded = [letters_of(samples[k]) for k in self.langs]
        every, n = np.unique(np.concatenate(coded), return_counts=True) if coded else (np.zeros(0, np.uint32), np.zeros(0, int))
        every = every[np.lexsort((every, -n))]
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[every] = np.arange(1, len(every) + 1)
        self.width = width = min(ALPHABET, len(every) + 1)
        self.codes = len(every) + 1
        tables, base, rare = [], 0, [np.zeros((0, 2), dtype=np.int64)]
        self.start = np.zeros(len(self.langs), dtype=np.int32)
        # All automata in one table: state ids are offsets of rows, a language's start marks "no transition".
        for k, c in enumerate(coded):
            codes = self.code[c]
            t, far = _automaton(codes, width)
            t[:, 0] = 0
            tables.append((t + base) * width)
            self.start[k] = base * width
            rare += [np.array([((state + base) * width * self.codes + code, (to + base) * width) for state, code, to in far], dtype=np.int64).reshape(-1, 2)]
            base += len(t)
        self.go = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        rare = np.concatenate(rare)
        rare = rare[np.argsort(rare[:, 0])]
        self.rare_from, self.rare_to = rare[:, 0].copy(), rare[:, 1].astype(np.int32)
        self.bits = np.array([math.log2(max(2, len(c))) for c in coded])

    def _next(self, state: np.ndarray, code: np.ndarray, start: int) -> np.ndarray:
        """The states after code, a language's start where there is no transition."""
        if not len(self.rare_from):
            return self.go[state + code]
        far = np.flatnonzero(code >= self.width)
        new = self.go[state + np.where(code < self.width, code, 0)]
        if len(far):
            key = state[far].astype(np.int64) * self.codes + code[far]
            at = np.minimum(np.searchsorted(self.rare_from, key), len(self.rare_from) - 1)
            new[far] = np.where(self.rare_from[at] == key, self.rare_to[at], start)
        return new

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text's cross-parsing times the bits of a phrase's pointer, per character."""
        out = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // SEGMENT) for t in texts])
        if not len(owner) or not self.langs:
            return out
        segments = [t[k : k + SEGMENT] for t in texts for k in range(0, len(t), SEGMENT)]
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((SEGMENT, len(segments)), dtype=np.int32)
        for k, o in enumerate(order):
            grid[: sizes[o], k] = self.code[segments[o]]
        active = np.searchsorted(-sizes[order], -np.arange(SEGMENT), side="left")
        for lang, start in enumerate(self.start):
            state = np.full(len(segments), start, dtype=np.int32)
            count = np.ones(len(segments), dtype=np.int64)
            for k in range(SEGMENT):
                n = active[k]
                if not n:
                    break
                c = grid[k, :n]
                new = self._next(state[:n], c, start)
                stop = np.flatnonzero(new == start)
                count[stop] += 1
                new[stop] = self._next(np.full(len(stop), start, dtype=np.int32), c[stop], start)
                state[:n] = new
            np.add.at(out[:, lang], owner[order], count)
        lengths = np.maximum(1, [len(t) for t in texts])
        return out * self.bits / lengths[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded = [letters_of(t) if t else np.zeros(0, np.uint32) for t in texts]
        cost = self.phrases(coded)
        out = []
        for c, row in zip(coded, cost, strict=True):
            if not len(self.langs) or not c.any():
                out.append((UNDETERMINED, 0.0))
                continue
            order = np.argsort(row, kind="stable")
            second = row[order[1]] if len(order) > 1 else 2 * row[order[0]]
            out.append((self.langs[order[0]], float(max(0.0, 1 - row[order[0]] / second)) if second > 0 else 0.0))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame) -> dict[str, str]:
    """Text by language from docs (doc_id, text, lang): the bounded training sample, from documents that are not held out.

    Of each language, the document of the least hash in each of SAMPLE_DOCUMENTS hash
    classes gives an equal share of its characters, from a place that its hash tells. Rows
    without doc_id, text or lang give none; rows that repeat a doc_id give one share.
    """
    h = F.xxhash64(F.lit(7), F.col("doc_id").cast("long"))
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    least = [r["h"] for r in usable.groupBy("lang", F.pmod(h, F.lit(SAMPLE_DOCUMENTS))).agg(F.min(h).alias("h")).collect()]
    if not least:
        return {}
    picked: dict[str, dict[int, str]] = {}
    share = SAMPLE_CHARS_A_LANGUAGE * 4 // SAMPLE_DOCUMENTS
    place = (1 + F.pmod(F.xxhash64(F.lit(8), F.col("doc_id").cast("long")), F.greatest(F.lit(1), F.length("text") - share + 1))).cast("int")
    for r in usable.filter(h.isin(least)).select("lang", h.alias("h"), F.substring(F.col("text"), place, F.lit(share)).alias("text")).collect():
        known = picked.setdefault(r["lang"], {})
        known[r["h"]] = max(known.get(r["h"], ""), r["text"])
    most = min(SAMPLE_CHARS_A_LANGUAGE, SAMPLE_CHARS // len(picked))
    return {lang: " ".join(t for _, t in sorted(texts.items()))[:most] for lang, texts in picked.items()}


_parsers: dict = {}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; predictions read the whole text and nothing else.

    A text that is null or has no letter is `und` with score 0, as is every text if there are
    no samples. Equal costs go to the language first by name. All rows and columns stay, rows
    that repeat too; a column of docs that is called lang_pred or score stays under that name
    with underscores after it. Rows of an empty table: none.
    """
    from pyspark.sql import types as T

    key = hash(tuple(sorted(samples.items())))

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts):
        import pandas as pd

        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(samples)
        found, batch, size = [], [], 0
        for t in [*texts, None]:
            batch.append(t)
            size += len(t or "")
            if size > 1_000_000:
                found += _parsers[key].predict(batch)
                batch, size = [], 0
        found += _parsers[key].predict(batch)
        return pd.DataFrame(found[:-1], columns=["lang_pred", "score"])

    found = unused(docs, "_found")
    kept = [F.col(f"`{c}`").alias(unused(docs, c) if c.lower() in ("lang_pred", "score") else c) for c in docs.columns]
    return docs.withColumn(found, predict(F.col("text"))).select(*kept, F.col(f"{found}.lang_pred").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), sample(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
