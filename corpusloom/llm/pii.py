"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers grow them into spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key")
ACCOUNT_CUES = ("account", "acct", "iban")
LEAST_SECRET = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"""[^\s<>"'`{}|\\^\[\]]+""")
_VALUE = re.compile(r"""["']?[\x20\t]{0,3}[:=][\x20\t]{0,3}["']?([A-Za-z0-9_+/=.-]+)""")
_NUMBER = re.compile(r"[\x20\t]{0,3}(?:[Nn]o\.?|[Nn]umber)?[\x20\t]{0,3}[:=#]?[\x20\t]{0,3}([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9])+)")
_AWS = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")

_machine = None


def _automaton():
    import ahocorasick

    global _machine
    if _machine is None:
        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, "digit")
        for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("AKIA", "aws")):
            a.add_word(word, kind)
        for cues, kind in ((SECRET_CUES, "secret"), (ACCOUNT_CUES, "account")):
            for c in cues:
                for form in {c, c.upper(), c.capitalize()}:
                    a.add_word(form, kind)
        a.make_automaton()
        _machine = a
    return _machine


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = re.sub(r"[\x20-]", "", text)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _number_at(text: str, at: int, ends: dict, out: list) -> None:
    """The address and the card number that start at the digit run at `at`; both start where a run does and end where one does."""
    if at >= ends["ip"] and (m := _IP.match(text, at)):
        ends["ip"] = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", at, m.end()))
    if at >= ends["card"] and (m := _CARD.match(text, at)):
        ends["card"] = m.end()
        digits = re.sub(r"[\x20-]", "", m[0]) if m.end() - at <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", at, m.end()))


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, by start and then kind as in KINDS.

    The base kinds follow their patterns exactly: leftmost, without overlap within a kind,
    failing matches dropped without another try. url, secret and account are added by the
    anchors "://", credential cues and account cues. Null and empty texts have no spans.
    Every anchor of the automaton is expanded where it stands: signs and cues, and the first
    digit of each run of digits for addresses and card numbers.
    """
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    ends = dict.fromkeys(KINDS, 0)
    for last, kind in _automaton().iter(text):
        if kind == "digit":
            if last == 0 or text[last - 1] not in _DIGITS:
                _number_at(text, last, ends, out)
        elif kind == "at":
            start = last
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                out.append(("email", start, m.end()))
                ends["email"] = m.end()
        elif kind == "plus":
            if last >= ends["phone"] and (m := _PHONE.match(text, last)):
                ends["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", last, m.end()))
        elif kind == "scheme":
            start = last - 2
            while start > max(ends["url"], last - 22) and text[start - 1] in _SCHEME:
                start -= 1
            while start < last - 2 and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < last - 2 and (m := _REST.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)"))
                if end > last + 1 and text[last + 1].isalnum():
                    out.append(("url", start, end))
                    ends["url"] = end
        elif kind == "aws":
            if last - 3 >= ends["secret"] and (m := _AWS.match(text, last - 3)):
                out.append(("secret", last - 3, m.end()))
                ends["secret"] = m.end()
        elif kind == "secret":
            if last + 1 >= ends["secret"] and (m := _VALUE.match(text, last + 1)):
                if len(m[1]) >= LEAST_SECRET and any(c.isdigit() for c in m[1]):
                    out.append(("secret", m.start(1), m.end(1)))
                    ends["secret"] = m.end(1)
        elif last + 1 >= ends["account"] and (m := _NUMBER.match(text, last + 1)):
            n = sum(c.isdigit() for c in m[1])
            if _iban(m[1]) or (n == len(re.sub(r"[\x20-]", "", m[1])) and 6 <= n <= 18):
                out.append(("account", m.start(1), m.end(1)))
                ends["account"] = m.end(1)
    rank = {k: n for n, k in enumerate(KINDS)}
    out.sort(key=lambda s: (s[1], rank[s[0]]))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    parts, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(SPANS)
def pii_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts], index=texts.index, dtype=object)


@F.pandas_udf(T.StringType())
def pii_redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([None if t is None else redact(t, find_spans(t)) for t in part], index=part.index, dtype=object)


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) as (doc_id, spans): one row per row, whatever its other columns; spans is empty without finds."""
    return docs.select("doc_id", pii_spans(F.col("text")).alias("spans"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced; all rows and columns stay, null texts stay null."""
    return docs.withColumn("text", pii_redacted(F.col("text")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
