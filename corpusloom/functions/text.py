"""Text expressions: keyword rules, tokens, numbers and page markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_present(text: Column, word: str) -> Column:
    """A phrase with a space by substring, a single word at word boundaries; case is ignored."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains(word) if " " in word else low.rlike(rf"(?U)\b{word}\b")


def any_keyword(text: Column, words: list[str]) -> Column:
    """Any of words as a substring; case is ignored, null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.lit(False))


def distinct_keywords(text: Column, words: list[str]) -> Column:
    """How many of words occur as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.contains(w).cast("long") for w in words], F.lit(0).cast("long"))


def first_match(rules: list[tuple[str, Column]], default: Column | str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for label, holds in rules:
        out = F.when(holds, F.lit(label)) if out is None else out.when(holds, F.lit(label))
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default) if out is not None else default


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """White-space separated tokens; 0 for null or empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")).cast("long")


def language_hint(text: Column, lists: dict[str, list[str]]) -> Column:
    """The language with the most of its function words among the text's words; ties, and texts without any, go to the first listed."""
    listed = F.array(*map(F.lit, sorted({w for v in lists.values() for w in v})))

    def best(present: Column) -> Column:
        scores = {k: F.size(F.array_intersect(present, F.array(*map(F.lit, v)))) for k, v in lists.items()}
        top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
        return first_match([(k, s == top) for k, s in scores.items()], next(iter(lists)))

    # A lambda's variable holds the text's listed words, else each score would split the text again.
    return F.transform(F.array(F.array_intersect(words(text), listed)), best)[0]


#: A number as written: thousands by comma, decimals, a percent sign; no word goes on before or after it.
NUMBER = r"\b(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:%\B|\b)"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U)({NUMBER})"), F.lit(1))


def number_value(raw: Column) -> Column:
    return F.regexp_replace(raw, "[,%]", "").try_cast("double")


def number_key(raw: Column) -> Column:
    """For cross-reference: without comma, percent sign and a zero fraction."""
    return F.regexp_replace(F.regexp_replace(raw, "[,%]", ""), r"\.0+$", "")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles out, white space single."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\x0B]+", " "))


def rough_text(html: Column, most: int = 2000) -> Column:
    """Markup out, white space single, the first characters: what a guess of the language reads."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<[^>]+>", " "), r"\s+", " ")
    return F.substring(F.trim(bare), 1, most)


def main_text(html: Column, least: int = 100) -> Column:
    """Visible text of the first <article>, else <main>; of the whole page where that is shorter than least and than the page's."""
    part = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    main, whole = visible_text(F.coalesce(part("article"), part("main"), F.lit(""))), visible_text(html)
    return F.when((F.length(main) < least) & (F.length(whole) > F.length(main)), whole).otherwise(main)


def hrefs(html: Column) -> Column:
    """The href values of <a> tags in order, as written: in double, single or no quotes."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)(<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""), F.lit(1))
    value = lambda tag: F.regexp_extract(tag, r"""(?is)^<a\s(?:[^>"'=\s]++|\s++|=|"[^"]*+"|'[^']*+')*?(?<=[\s"'])href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)
    return F.transform(F.filter(F.transform(tags, value), lambda x: x != ""), lambda x: F.regexp_replace(x, r"""^["']|["']\z""", ""))


#: Signals of a page that a bot check or a refusal stands in for.
CHALLENGES = ["checking your browser", "just a moment", "please wait", "403 error", "request blocked", "access denied", "enable javascript", "voight-kampff", "validation request", "user validation required", "captcha", "prove you are human"]


def challenged(html: Column, signals: list[str] | None = None) -> Column:
    """Any signal in the title or the first 500 characters; case is ignored."""
    signals = CHALLENGES if signals is None else signals
    return any_keyword(F.substring(html, 1, 500), signals) | any_keyword(title(html), signals)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words ([a-z0-9:]+ of the lower-cased text)."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9:]+)"), F.lit(1))
    none = F.array().cast("array<string>")
    # A lambda binds the words once; named in the inner lambda, they would be matched anew for each run.
    runs = lambda ws: F.when(F.size(ws) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " ")))).otherwise(none)
    return F.element_at(F.transform(F.array(w), runs), 1)


def without_thoughts(text: Column) -> Column:
    """Thinking blocks out, then white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?U)\A[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+\z", "")


def repaired_answers(raw: Column, fields: str, expected: int) -> Column:
    """Exactly `expected` structs of fields (a DDL) from a model's answer: its first JSON array, else its first object.

    Fences go; what follows the JSON is left out; missing entries are structs of nulls, surplus ones are cut.
    """
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^```(?:json)?|```$", ""))
    many = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), f"array<struct<{fields.replace(' ', ':', 1)}>>")
    one = F.from_json(F.regexp_extract(bare, r"(\{[^{}]+\})", 1), f"struct<{fields.replace(' ', ':', 1)}>")
    found = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<struct<{fields.replace(' ', ':', 1)}>>"))
    empty = F.from_json(F.lit("{}"), f"struct<{fields.replace(' ', ':', 1)}>")
    return F.slice(F.concat(found, F.array_repeat(empty, expected)), 1, expected)


def slug(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_"))
