"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page in the context of all its others."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import table

PATH_DIM, WORD_DIM, STATS = 128, 32, 6
HIDDEN, EPOCHS, RATE, TRAINING_PAGES = 16, 14, 0.01, 480
#: Pages that are labelled together, and padded blocks of them at most.
PAGES_AT_ONCE, BLOCKS_AT_ONCE = 128, 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var del wbr br img".split())
#: Tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote body details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table td th tr ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[A-Za-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)|\Z", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks in page order: path (tags and class names from the root), text, characters of it in links.

    A block is the text between two block-level tags, its inline tags removed, character
    references decoded and white space made single. What scripts, styles and the head hold is
    not text. A quote opens an attribute's value only after an equals sign. An unclosed tag, or
    value, at the page's end is markup.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    out, text, linked, in_link, in_title, at = [], [], 0, 0, 0, 0

    def flush():
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append((path, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    while (m := _TOKEN.match(page, at)) is not None:
        at = m.end()
        end_tag, tag, attributes, plain = m.groups()
        if plain is not None:
            if not in_title:
                text.append(plain)
                if in_link:
                    linked += len(plain)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not end_tag:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                at = _RAW_END[tag].search(page, at).end()
            text.append(" ")
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag == "title":
            in_title = not end_tag
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if end_tag else 1
            continue
        flush()
        in_link = 0
        if end_tag:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            names = [n.lower() for g in _NAMES.findall(attributes) for n in _NAME_PART.findall("".join(g))] if attributes else []
            stack.append((tag, (tag, *("." + n for n in names))))
        path = tuple(x for _, own in stack for x in own)
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 20_000:
            _paths.clear()
        v = np.zeros(PATH_DIM, dtype=np.float32)
        for k, x in enumerate(path):
            v[zlib.crc32(x.encode()) % PATH_DIM] += 1
            if k == len(path) - 1:
                v[zlib.crc32(b"leaf " + x.encode()) % PATH_DIM] += 1
        _paths[path] = np.minimum(v, 2)
    return _paths[path]


def features(page: list[tuple[tuple[str, ...], str, int]], first: int = 0, length: int | None = None) -> np.ndarray:
    """(blocks, PATH_DIM + WORD_DIM + STATS): tag path, hashed words over all of the block, and its form.

    The blocks may be a part of a page of `length`, from its block `first` on.
    """
    length = length or len(page)
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + STATS), dtype=np.float32)
    crc = zlib.crc32
    for k, (path, text, linked) in enumerate(page):
        out[k, :PATH_DIM] = _path_vector(path)
        words = text.lower().split()
        n = len(words)
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.minimum(np.bincount([crc(w.encode()) % WORD_DIM for w in words], minlength=WORD_DIM) / n**0.5 / 2, 1)
        out[k, -STATS:] = (np.log1p(n) / 4, linked / len(text), text[-1] in ".!?", (first + k) / length, "©" in text, n < 4)
    return out


class BlockLabeller:
    """Bidirectional LSTM with one logistic output a block, in numpy."""

    def __init__(self, dim: int = PATH_DIM + WORD_DIM + STATS, hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        init = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": init(dim, 4 * hidden), f"h{d}": init(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1
        self.p |= {"o": init(2 * hidden, 1), "oc": np.zeros(1, np.float32)}

    @staticmethod
    def _s(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x, mask, d, keep=True, start=None):
        """Hidden states (time, page, hidden) in one direction, and with keep all gates; padding keeps a page's state. start: (state, cell) before."""
        t, n, _ = x.shape
        h, hs = self.hidden, []
        pre = x.reshape(t * n, -1) @ self.p["x" + d] + self.p["c" + d]
        pre = pre.reshape(t, n, 4 * h)
        state, cell = start or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        steps = []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[k] + state @ self.p["h" + d]
            i, f, o, g = self._s(z[:, :h]), self._s(z[:, h : 2 * h]), self._s(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            m = mask[k][:, None]
            new_cell = m * (f * cell + i * g) + (1 - m) * cell
            th = np.tanh(new_cell)
            new_state = m * (o * th) + (1 - m) * state
            if keep:
                steps.append((k, state, cell, i, f, o, g, th, m))
            state, cell = new_state, new_cell
            hs.append(state)
        return np.stack(hs if d == "f" else hs[::-1]), steps if keep else (state, cell)

    def scores(self, x, mask):
        f, b = (self._run(x, mask, d, keep=False)[0] for d in "fb")
        return self._s(np.concatenate([f, b], axis=2) @ self.p["o"] + self.p["oc"])[:, :, 0]

    def gradients(self, x, mask, y):
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        s = self._s(both @ self.p["o"] + self.p["oc"])[:, :, 0]
        e = ((s - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {"o": both.reshape(-1, both.shape[2]).T @ e.reshape(-1, 1), "oc": e.sum(axis=(0, 1))}
        d_both = e @ self.p["o"].T
        h = self.hidden
        for d, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
            gh, dh, dc = np.zeros_like(self.p["h" + d]), 0, 0
            for k, state, cell, i, f, o, gg, th, m in reversed(runs[d][1]):
                total = part[k] + dh
                own = total * m
                d_cell = dc * m + own * o * (1 - th * th)
                z = np.concatenate([d_cell * gg * i * (1 - i), d_cell * cell * f * (1 - f), own * th * o * (1 - o), d_cell * i * (1 - gg * gg)], axis=1)
                dz[k] = z
                gh += state.T @ z
                dh, dc = z @ self.p["h" + d].T + total * (1 - m), d_cell * f + dc * (1 - m)
            flat = dz.reshape(-1, 4 * h)
            g |= {"x" + d: x.reshape(len(flat), -1).T @ flat, "h" + d: gh, "c" + d: flat.sum(axis=0)}
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5):
        r, m1, m2, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for k in range(0, len(order), 24):
                x, mask, y = padded([pages[i] for i in order[k : k + 24]], [labels[i] for i in order[k : k + 24]])
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[name] = 0.9 * m1.get(name, 0) + 0.1 * g
                    m2[name] = 0.99 * m2.get(name, 0) + 0.01 * g * g
                    self.p[name] = (self.p[name] - RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        if not pages:
            return []
        x, mask, _ = padded(pages)
        s = self.scores(x, mask)
        return [s[: len(p), k] > 0.5 for k, p in enumerate(pages)]

    def label_long(self, page, at_once: int) -> np.ndarray:
        """label for one page of blocks, of which so many have their features at once; the states go on from one part to the next."""
        starts = list(range(0, len(page), at_once))
        states = {d: np.zeros((len(page), self.hidden), np.float32) for d in "fb"}
        for d, order in (("f", starts), ("b", starts[::-1])):
            last = None
            for k in order:
                x = features(page[k : k + at_once], k, len(page))[:, None]
                hs, last = self._run(x, np.ones(x.shape[:2], np.float32), d, keep=False, start=last)
                states[d][k : k + at_once] = hs[:, 0]
        return (self._s(np.concatenate([states["f"], states["b"]], axis=1) @ self.p["o"] + self.p["oc"]) > 0.5)[:, 0]


def padded(pages, labels=None):
    t = max(1, *(len(p) for p in pages))
    x = np.zeros((t, len(pages), PATH_DIM + WORD_DIM + STATS), np.float32)
    mask, y = np.zeros((t, len(pages)), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
        if labels is not None:
            y[: len(p), k] = labels[k]
    return x, mask, y


def made_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page of invented words for training, and which of its blocks are main text."""
    syllables = [r.choice("bcdfghjklmnprstvwzéçüñ") + r.choice("aeiouäöêá") + r.choice(["", "n", "r", "s", "th"]) for _ in range(40)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    sentence = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["."] * 8 + ["!", ""])
    plain = lambda: " ".join(sentence(1, 24) for _ in range(r.choice([1, 1, 1, 2, 4, 8])))

    def prose() -> str:
        """Sentences, and now and then words parted or decked with signs, capitals or numbers."""
        roll = r.random()
        if roll < 0.8:
            return plain()
        words = [word() for _ in range(r.choice([2, 5, 12, 30, 60]))]
        if roll < 0.82:
            return " ".join(words[:1] * r.randint(5, 80))
        if roll < 0.88:
            return r.choice([" | ", " - ", " / ", ", "]).join(words) + r.choice([" |", ""])
        if roll < 0.94:
            return " ".join(w + r.choice(["###", "***", "$$$", "%%%", "&amp;&amp;", "!!"]) for w in words)
        return r.choice([" ".join(words).upper(), " ".join(w if r.random() < 0.5 else str(r.randint(0, 99999)) for w in words)])

    some = lambda words, n=4: " ".join(r.choice(words.split()) for _ in range(r.randint(1, n)))
    labels: list[bool] = []
    fill = lambda known: r.choice([known, known, sentence(1, 9), f"{known} {word()}"])

    def off(text: str) -> str:
        labels.append(False)
        return text

    def links(kind: str) -> str:
        items = "".join(f"<li><a href='/{k}'>{off(r.choice([word(), some('home about contact login menu search news', 2)]))}</a></li>" for k in range(r.randint(2, 7)))
        return f"<{kind}>{items}</{kind}>"

    def chunk(kind: str) -> str:
        name = lambda *names: f'{r.choice(["class", "class", "id"])}="{r.choice(names)}"'
        if kind == "nav":
            opening, closing = r.choice([("<nav>", "</nav>"), (f"<div {name('menu', 'navbar', 'nav-links', 'breadcrumb')}>", "</div>"), (f"<nav {name('menu', 'main-nav')}>", "</nav>")])
            return opening + links("ul") + closing
        if kind == "header":
            return f"<header>{off(sentence(1, 4))}<p>{off(fill('Welcome'))}</p></header>" if r.random() < 0.6 else f"<div {name('header', 'masthead', 'site-header')}><p>{off(sentence(1, 6))}</p></div>"
        if kind == "ad":
            return f"<div {name('ad', 'ad', 'ads', 'advert', 'banner', 'promo', 'sponsored')}>{r.choice(['<p>', '', ''])}{off(r.choice([prose(), 'Advertisement', fill('Sponsored offer')]))}</div>"
        if kind == "notice":
            return f"<div {name('cookie-notice', 'cookie', 'consent', 'notice', 'popup', 'alert')}><p>{off(fill('We use cookies accept privacy policy'))}</p></div>"
        if kind == "aside":
            tag = r.choice(["aside", "aside", "div"])
            inner = "".join(f"<p>{off(prose())}</p>" for _ in range(r.randint(1, 3))) + (links("ul") if r.random() < 0.5 else "")
            return f"<{tag} {name('sidebar', 'widget', 'related', 'recommended')}><h3>{off(fill('Related posts'))}</h3>{inner}</{tag}>"
        if kind == "form":
            return f"<form {name('newsletter', 'search', 'subscribe', 'login')}><p>{off(fill('Subscribe to our newsletter'))}</p><label>{off('Email')}<input name=q></label><div>{off('Send')}</div></form>"
        if kind == "comments":
            tag = r.choice(["section", "div", "ol"])
            item = "li" if tag == "ol" else "div"
            return f"<{tag} {name('comments', 'comment-list', 'replies', 'discussion')}>" + "".join(f'<{item} class="comment"><p>{off(prose())}</p></{item}>' for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if kind == "footer":
            host = f"{word()}.example.{r.choice(['com', 'org', 'net'])}"
            return f"<footer>{off(r.choice([f'&copy; {host} &middot; {prose()}', f'Copyright {host}', prose()]))}</footer>" if r.random() < 0.7 else f"<div {name('footer', 'site-footer')}><p>{off('&copy; ' + prose())}</p></div>"
        raise ValueError(kind)

    def main() -> str:
        opening, closing = r.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body entry">', "</div>"), ('<section class="story article">', "</section>")])
        out = [opening]

        def on(text: str) -> str:
            labels.append(True)
            return text

        if r.random() < 0.85:
            out.append(f"<h1>{on(sentence(1, 9))}</h1>")
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            roll = r.random()
            if roll < 0.68:
                out.append(f"<p>{on(prose())}</p>")
            elif roll < 0.8:
                out.append(f"<p><b>{on(prose())}<br>")
            elif roll < 0.86:
                out.append(f"<h2>{on(sentence(1, 6))}</h2>")
            elif roll < 0.9:
                out.append(f"<blockquote><p>{on(prose())}</p></blockquote>")
            elif roll < 0.94:
                out.append("<ul>" + "".join(f"<li>{on(sentence(1, 9))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif roll < 0.96:
                out.append("<table><tr>" + "".join(f"<td>{on(word())}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(chunk(r.choice(["ad", "aside", "form"])))
        return "".join(out) + ("" if r.random() < 0.05 else closing)

    kinds = [k for k, p in (("notice", 0.2), ("header", 0.35), ("nav", 0.8), ("ad", 0.6), ("aside", 0.2), ("form", 0.15)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(kinds)
    parts = [chunk(k) for k in kinds] + ([main()] if r.random() < 0.97 else [])
    parts += [chunk(k) for k, p in (("ad", 0.2), ("comments", 0.3), ("aside", 0.3), ("form", 0.15), ("footer", 0.8)) if r.random() < p]
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", labels


@functools.cache
def train(pages: int = TRAINING_PAGES, seed: int = 3) -> BlockLabeller:
    """A labeller fitted on made pages, once in a process; the same for the same numbers."""
    r, x, y = random.Random(seed), [], []
    while len(x) < pages:
        page, labels = made_page(r)
        found = blocks(page)
        if found and len(found) == len(labels):
            x.append(features(found))
            y.append(np.array(labels, dtype=np.float32))
    return BlockLabeller().fit(x, y)


def main_texts(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """The main text of each page: its blocks that the model takes for it, one a line."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    while order:
        longest = len(found[order[-1]])
        if longest > BLOCKS_AT_ONCE:
            k = order.pop()
            out[k] = "\n".join(b[1] for b, yes in zip(found[k], model.label_long(found[k], BLOCKS_AT_ONCE), strict=True) if yes)
            continue
        take = max(1, min(len(order), BLOCKS_AT_ONCE // longest, PAGES_AT_ONCE))
        group, order = order[-take:], order[:-take]
        for k, on in zip(group, model.label([features(found[k]) for k in group]), strict=True):
            out[k] = "\n".join(b[1] for b, yes in zip(found[k], on, strict=True) if yes)
    return out


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html); text is empty for null or empty html or none found.

    Rows that repeat are extracted each; other columns are ignored, whatever they are called; an
    empty table gives no rows. A page of any length is labelled whole.
    """
    weights = (model or train()).p

    def run(batches):
        import pyarrow as pa

        own = BlockLabeller()
        own.p = weights
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(k, PAGES_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(main_texts(part.column("html").to_pylist(), own), pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
