"""Token ids of whole texts by their distinct space-separated parts."""

from __future__ import annotations

import os
import re

#: Characters of the texts that are encoded together; a longer text goes alone.
CHARS_AT_ONCE = 20_000_000
#: White space other than the space and the line feed.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x00"
_ODD_ASCII = [c for c in _ODD if c.isascii()]
#: A space between two characters that are no white space starts a new token for every pattern used here.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def marked(text: str) -> str:
    """text with a NUL at each cut; it must hold none. Cuts lie about single spaces and line feeds between other characters.

    A space goes with what follows it, a line feed is a part of its own; near other white space only the sure cuts are made.
    """
    if not text:
        return text
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in (_ODD_ASCII if text.isascii() else _ODD)):
        return "\0".join(_CUT.split(text))
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


#: At a part's end and after a letter, a token of its own.
_TAILS = ",.;:!?"


class PartEncoder:
    """encode: a list of parts to a list of their ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, encode, fold: bool = False, specials: tuple[str, ...] = ()):
        """fold: the encoder lower-cases, so parts that differ in the case of ASCII letters alone are one.

        specials: strings that the encoder takes for tokens of their own; a text that holds one, in any case, goes to it whole.
        """
        self.encode, self.fold, self.specials = encode, fold, tuple(s.lower() for s in specials)

    def _whole(self, text: str) -> bool:
        if "\0" in text:
            return True
        if not self.specials or "<" not in text and all("<" in s for s in self.specials):
            return False
        low = text.lower()
        return any(s in low for s in self.specials)

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each of some distinct parts."""
        # A part that ends in such a sign is put together from the two.
        tails = [p for p in parts if p[-1:] in _TAILS and p[-2:-1].lower().isalpha()]
        rest = [*{*(p[:-1] for p in tails), *_TAILS}.union(parts).difference(tails, [""])] if tails else [p for p in parts if p]
        known = {"": b""}
        for k in range(0, len(rest), 5000):
            group = rest[k : k + 5000]
            known.update(zip(group, self.encode(group), strict=True))
        for p in tails:
            known[p] = known[p[:-1]] + known[p[-1]]
        return [known[p] for p in parts]

    def _coded(self, parts):
        """_ids_of over Arrow arrays: distinct strings, none null, to their ids as binaries."""
        import pyarrow as pa

        return pa.array(self._ids_of(parts.to_pylist()), pa.large_binary())

    def batches(self, batch, chars: int = CHARS_AT_ONCE):
        """Yields (slice, ids of its texts) over an Arrow batch with a column `text`, about chars characters at once; null texts count as empty."""
        import pyarrow as pa

        texts = [t or "" for t in batch.column("text").to_pylist()]
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size > chars or k == len(texts) - 1:
                yield batch.slice(first, k + 1 - first), self.texts(texts[first : k + 1])
                texts[first : k + 1] = [""] * (k + 1 - first)
                pa.default_memory_pool().release_unused()
                first, size = k + 1, 0

    def texts(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as bytes; every distinct part of the batch is encoded once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not batch:
            return []
        whole = {k: t for k, t in enumerate(batch) if self._whole(t)}
        if self.fold:
            batch = [t.lower() if t.isascii() else t for t in batch]
        cut = pc.split_pattern(pa.array(["" if k in whole else marked(t) for k, t in enumerate(batch)], pa.large_string()), "\0")
        coded = cut.values.dictionary_encode()
        ids = self._coded(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        data = memoryview(data or b"")
        at = np.frombuffer(offsets, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1][cut.offsets.to_numpy()].tolist()
        out = [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
        for k, t in whole.items():
            out[k] = self.encode([t])[0]
        return out


#: A sign that both vocabularies hold as a token of its own after a space; parts with it are encoded alone.
_SIGN = "|"


#: Letters that every pattern used here takes for such, in any case, and that no normalisation joins to a neighbour.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Parts that the library gets at once.
_PACK = 200


class LibraryEncoder(PartEncoder):
    """Plain parts stay in Arrow arrays from the text to its ids; others take encode's way."""

    def __init__(self, tok, encode, sizes, marks: bool, sign: int):
        """sizes: bytes of each id, or 1 where it ends a word (marks: the vocabulary does so); sign: the id of _SIGN after a space."""
        super().__init__(encode, fold=marks, specials=tuple(t.content for t in tok.get_added_tokens_decoder().values()))
        self.tok, self.sizes, self.marks, self.sign = tok, sizes, marks, sign
        self.line = None if marks else tok.encode("a\nb", add_special_tokens=False).ids[1]

    def _coded(self, parts):
        import pyarrow as pa
        import pyarrow.compute as pc

        tailed = pc.match_substring_regex(parts, f"[{_LETTERS}][{_TAILS}]$")
        base = pc.if_else(tailed, pc.utf8_slice_codeunits(parts, 0, -1), parts).dictionary_encode()
        sign = pc.index_in(pc.utf8_slice_codeunits(parts, -1), pa.array(list(_TAILS), pa.large_string()))
        ends = pa.array(self.encode(list(_TAILS)), pa.large_binary()).take(pc.if_else(tailed, sign, None))
        none = pa.scalar(b"", pa.large_binary())
        return pc.binary_join_element_wise(self._distinct(base.dictionary).take(base.indices), pc.fill_null(ends, none), none)

    def _distinct(self, parts):
        """The ids of distinct parts by their kinds: plain words, other plain parts at the start of a line or after a space, the rest."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lead = " ?" if self.marks else " "
        kinds = [(f"^{lead}[{_LETTERS}]+$", "", None), (f"^{lead}[!-{{}}~{_LETTERS}]+$", f" {_SIGN}", self.sign)]
        if not self.marks:
            kinds.append((f"^[!-~{_LETTERS}]+$", "\n", self.line))
        places, found, left = [], [], np.ones(len(parts), dtype=bool)
        for pattern, after, cut in kinds:
            mine = left & pc.match_substring_regex(parts, pattern).to_numpy(zero_copy_only=False)
            left &= ~mine
            places.append(np.flatnonzero(mine))
            found.append(self._packed(parts.take(pa.array(places[-1])), after, cut))
        places.append(np.flatnonzero(left))
        found.append(pa.array(self._ids_of(parts.take(pa.array(places[-1])).to_pylist()), pa.large_binary()))
        back = np.empty(len(parts), dtype=np.int64)
        back[np.concatenate(places)] = np.arange(len(parts))
        return pa.concat_arrays(found).take(pa.array(back))

    def _packed(self, parts, after: str, cut: int | None):
        """The ids of plain parts, many at a time; each is followed by `after`, which gives the id cut, or is known to end by its tokens' sizes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        none = pa.scalar("", pa.large_string())
        if self.marks:
            parts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.utf8_ltrim(parts, " "), none)
        lengths, plain = np.ones(len(parts), dtype=np.int64) if self.marks else pc.binary_length(parts).to_numpy(), parts
        if after:
            parts = pc.binary_join_element_wise(parts, pa.scalar(after, pa.large_string()), none)
        if not len(parts):
            return pa.array([], pa.large_binary())
        offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data, at = memoryview(parts.buffers()[2]), [*range(0, len(parts), _PACK), len(parts)]
        stops = offsets[at].tolist()
        packs = self.tok.encode_batch_fast([str(data[a:b], "utf-8") for a, b in zip(stops, stops[1:], strict=False)], add_special_tokens=False)
        counts, kept = [], []
        for e, a, b in zip(packs, at, at[1:], strict=False):
            ids = np.array(e.ids, dtype="<u4")
            if after:
                ends = np.flatnonzero(ids == cut) - np.arange(b - a) if np.count_nonzero(ids == cut) == b - a else None
                ids = ids[ids != cut]
            else:
                reach, wanted = np.cumsum(self.sizes[ids]), np.cumsum(lengths[a:b])
                ends = np.searchsorted(reach, wanted) + 1
                if ends[-1] != len(ids) or (reach[ends - 1] != wanted).any():
                    ends = None
            if ends is None:
                each = [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(plain.slice(a, b - a).to_pylist(), add_special_tokens=False)]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            counts.append(np.diff(ends, prepend=0))
            kept.append(ids)
        ends = np.concatenate(([0], 4 * np.cumsum(np.concatenate(counts)))).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(kept))])


def library_encoder(path: str) -> LibraryEncoder:
    """The tokenizers library's ids without added special tokens, as it gives them by default.

    A special string in a text is thus its token; such a text goes to the library whole. New parts go to the library many at a time, parted by a sign that white space sets
    apart; parts that hold the sign or white space at an end go alone.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    sign = tok.encode(f"a {_SIGN} b", add_special_tokens=False).ids[1]
    raw = lambda e: np.array(e.ids, dtype="<u4")

    # A part of one word gives tokens of as many bytes as it has, or the last of them ends a word; no sign is needed then.
    vocabulary = tok.get_vocab()
    marks = '"continuing_subword_prefix"' in tok.to_str() and any(t.endswith("</w>") for t in vocabulary)
    sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for t, i in vocabulary.items():
        sizes[i] = t.endswith("</w>") if marks else len(t)

    def encode(group: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(group)
        alone: set[int] = set()
        words = [k for k, p in enumerate(group) if p[0] == " " and p[1:].isalpha() and (p.isascii() or not marks or (max(p) < "\u0250" and p[1:].lower().isalpha()))]
        for k, pack, e in batches(words, group, ""):
            ids = raw(e)
            reach = np.cumsum(sizes[ids])
            wanted = np.arange(1, len(pack) + 1) if marks else np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in map(group.__getitem__, pack)])
            stops = np.searchsorted(reach, wanted) + 1
            if stops[-1] != len(ids) or (reach[stops - 1] != wanted).any():
                alone.update(pack)
                continue
            place(out, pack, ids.tobytes(), np.concatenate(([0], stops[:-1])).tolist(), stops.tolist())
        rest = set(range(len(group))).difference(words)
        apart = [k for k in rest if (p := group[k])[0] == " " and _SIGN not in p and len(p) > 1 and not p[-1].isspace()]
        for k, pack, e in batches(apart, group, f" {_SIGN}"):
            ids = raw(e)
            cuts = np.flatnonzero(ids == sign)
            if len(cuts) != len(pack) - 1:
                alone.update(pack)
                continue
            place(out, pack, ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        # Also those whose tokens could not be told apart in a pack.
        alone = sorted(alone.union(rest.difference(apart)))
        for k, e in zip(alone, tok.encode_batch_fast([group[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = raw(e).tobytes()
        return out

    def batches(chosen: list[int], group: list[str], between: str):
        packs = [chosen[k : k + 200] for k in range(0, len(chosen), 200)]
        found = tok.encode_batch_fast([between.join([group[k] for k in pack]) for pack in packs], add_special_tokens=False)
        return zip(range(len(packs)), packs, found, strict=True)

    def place(out: list[bytes], pack: list[int], data: bytes, starts: list[int], stops: list[int]) -> None:
        for k, a, b in zip(pack, starts, stops, strict=True):
            out[k] = data[4 * a : 4 * b]

    return LibraryEncoder(tok, encode, sizes, marks, sign)
