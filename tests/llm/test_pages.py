"""Blocks of pages against a parser that reads one character at a time, and long pages."""

import html
import random
import re

import pytest

from corpusloom.llm import html_text


def slow_tokens(page):
    """('text', s), ('open' or 'close', name, attributes) in page order, by the states of a tokeniser."""
    at, n = 0, len(page)
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "text", page[at:end]
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        k = at + 1
        closing = page[k : k + 1] == "/"
        k += closing
        if not re.match("[A-Za-z]", page[k : k + 1]):
            yield "text", "<"
            at += 1
            continue
        start = k
        while k < n and re.match("[A-Za-z0-9:-]", page[k]):
            k += 1
        name, start = page[start:k].lower(), k
        state = "name"
        while k < n:
            c = page[k]
            if state in ('"', "'"):
                state = "name" if c == state else state
            elif c == ">":
                break
            elif state == "value" and c in "\"'":
                state = c
            elif c == "=":
                state = "value"
            elif not c.isspace():
                state = "name"
            k += 1
        attributes = page[start:k]
        at = min(n, k + 1)
        yield ("close" if closing else "open"), name, attributes
        if not closing and name in html_text.RAW and not (attributes.endswith("/") and name in ("svg", "math")):
            m = re.search(rf"</{name}\b[^>]*(>|\Z)", page[at:], re.I)
            at = at + m.end() if m else n


def slow_blocks(page):
    """(innermost tags, text) of each block."""
    stack, out, text, title = [], [], [], False

    def flush():
        joined = re.sub(r"\s+", " ", html.unescape("".join(text))).strip()
        if joined:
            out.append((tuple(stack), joined))
        text.clear()

    for kind, name, *_ in slow_tokens(page):
        if kind == "text":
            if not title:
                text.append(name)
        elif name in html_text.RAW and kind == "open":
            text.append(" ")
        elif name == "br":
            text.append("\n")
        elif name == "title":
            title = kind == "open"
        elif name == "hr":
            flush()
        elif name not in html_text.VOID and name not in html_text.INLINE:
            flush()
            if kind == "close":
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            else:
                if stack and (name in html_text.CLOSES_P and stack[-1] == "p" or name == stack[-1] == "li"):
                    stack.pop()
                stack.append(name)
    flush()
    return out


PIECES = ["<p>", "</p>", "<p title=don't>", "<div class='a b'>", "</div>", "<li>", "<ul>", "</ul>", "<br>", "<hr/>", "<a href=x>", "</a>", "<b>", "</b>", "it's ", "a < b ", "&amp;", "&lt;p&gt;", " \n\t", "word ", "\"said\" ", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<!-- <p>no -->", "<!doctype html>", "<title>t</title>", "<p title=\"a>b\">", "<p data-x = 'c>d' \"e>", "<svg/>", "<p a=b\"c>", "</ p>", "<3", "<p x='' y>", "=", "'", "<p title=>"]


def test_blocks_equal_a_slow_parser():
    r = random.Random(4)
    for _ in range(4000):
        page = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) + r.choice(["", "", "<p title='open", "<div", "<!-- open", "<"])
        got = [(tuple(x for x in path if x[0] != "."), text) for path, text, _ in html_text.blocks(page)]
        assert got == slow_blocks(page), page


def test_quotes_in_unquoted_values_lose_no_text():
    page = "<article><p title=don't>Hello there</p><p>it's more text here.</p><p>last</p></article>"
    assert [b[1] for b in html_text.blocks(page)] == ["Hello there", "it's more text here.", "last"]


@pytest.mark.parametrize("at_once", [7, 64])
def test_a_long_page_is_labelled_as_a_whole(monkeypatch, at_once):
    r, pages = random.Random(8), []
    while len(pages) < 6:
        pages.append(html_text.made_page(r)[0])
    page, model = "".join(pages), html_text.train()
    whole = html_text.main_texts([page], model)
    assert whole[0]
    monkeypatch.setattr(html_text, "BLOCKS_AT_ONCE", at_once)
    assert html_text.main_texts([page, None, pages[0]], model)[0] == whole[0]
