"""Token ids of texts by the tokenizers library, with a cache of pieces between spaces and line ends.

A byte-level BPE splits a text before it merges, and always before a space or a line feed that stands between two
characters that are not white space. Pieces cut there can be encoded one by one, and most of them recur. A piece of letters
alone is not split further, so its bytes go to the model without the pattern that splits texts.
A tokenizer file that splits texts in another way is recognised, and its texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from attesta.llm.textvec import held

#: Pieces that a worker remembers before it starts anew, and the longest one; they bound its memory.
REMEMBERED, LONGEST = 700_000, 48
_MARKS = ".,;:!?"
#: Letters up to U+024F, which every Unicode version knows, and a mark.
_MARKED = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]{1,40}[.,;:!?]").fullmatch
_LETTERS = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]+").fullmatch
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _letters_of_bytes() -> dict[int, str]:
    """The character that a byte-level model has for each byte: itself if it can be seen, else the next one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _letters_of_bytes()


def _cuts(spec: dict) -> bool:
    """Whether texts may be cut into pieces, by the tokenizer's description."""
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    added = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]
    return bool(plain) and not added and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")


class Encoder:
    """Ids of texts as little-endian unsigned integers of width bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.cuts = _cuts(json.loads(self.model.to_str()))
        feed = self.model.encode("a\nb", add_special_tokens=False).ids
        self.feed = feed[1] if len(feed) == 3 and self.cuts else None
        self.words = Tokenizer.from_file(path)  # of pieces of letters, as bytes, with the line feed's byte between them
        self.words.pre_tokenizer = pre_tokenizers.Split(_BYTES[10], "isolated")
        self.marks = dict(zip(_MARKS, self._ids(list(_MARKS)), strict=True))
        self.firsts: dict[str, bytes] = {}  # by a text's first piece, its ids
        self.known: dict[str, bytes] = {}  # by piece, the ids of a space and the piece

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as if it were encoded whole."""
        if not self.cuts:
            return self._ids(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, firsts = self.known, self.firsts
        get = known.get
        cut, found, gaps = [], [], []
        missing: set[str] = set()

        def look(p: list[str]) -> tuple[list[bytes | None], list[int]]:
            v = list(map(get, p))
            v[0] = b""
            g = [i for i, x in enumerate(v) if x is None] if None in v else []
            missing.update([p[i] for i in g])
            return v, g

        for t in texts:
            p = t.replace("\n", " \n").split(" ")
            v, g = look(p)
            cut.append(p)
            found.append(v)
            gaps.append(g)
        odd = {p for p in missing if not p.isalpha() and _odd(p)}
        for i, p in enumerate(cut):
            # White space meets a space or line feed here: cut with care.
            if len(p) > 1 and (not p[0] or p[0][-1].isspace() or odd and not odd.isdisjoint([p[j] for j in gaps[i]])):
                cut[i] = p = _CUT.split(texts[i])
                found[i], gaps[i] = look(p)
        new = self._learned(list(missing - odd))
        known.update(new if max(map(len, new), default=0) <= LONGEST else {p: ids for p, ids in new.items() if len(p) <= LONGEST})
        heads = [p[0] for p in cut]
        unseen = list({h for h in heads if h not in firsts})
        firsts.update(zip(unseen, self._ids(unseen), strict=True))
        for h, p, v, g in zip(heads, cut, found, gaps, strict=True):
            v[0] = firsts[h]
            for i in g:
                v[i] = new[p[i]]
        out = [b"".join(v) for v in found]
        if len(firsts) > 100_000 or any(len(h) > 1000 for h in unseen):
            firsts.clear()
        return out

    def _between(self, out: dict[str, bytes], pieces: list[str], model, joined) -> None:
        """The ids of pieces, read between line feeds."""
        for at in range(0, len(pieces), 200):
            some = pieces[at : at + 200]
            row = np.array(model.encode_batch_fast([joined(some)], add_special_tokens=False)[0].ids, self.dtype)
            ids, ends, w, first = row.tobytes(), [*np.flatnonzero(row == self.feed).tolist(), len(row)], self.width, 0
            for p, e in zip(some, ends, strict=True):
                out[p] = ids[first * w : e * w]
                first = e + 1

    def _learned(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece after its space or line feed. Many are encoded as one text, with a line feed between them, which is an id of its own there."""
        if self.feed is None:
            return dict(zip(pieces, self._ids([p if p[0] == "\n" else " " + p for p in pieces]), strict=True))
        fed, letters, marked, rest = [], [], [], []
        for p in pieces:  # what is in _LETTERS is alphabetic
            if p.isalpha():
                (letters if p.isascii() or _LETTERS(p) else rest).append(p)
            elif p[-1] in _MARKS and _MARKED(p):
                marked.append(p)
            else:
                (fed if "\n" in p else rest).append(p)
        out = dict(zip(fed, self._ids([p if p[0] == "\n" else " " + p for p in fed]), strict=True))
        # A word and one mark after it are always two parts: the word is looked up or learned by itself.
        bare = {p[:-1] for p in marked}
        known = self.known
        words = [p for p in bare if p not in known] + [p for p in letters if p not in bare]
        self._between(out, words, self.words, lambda some: (" " + "\n ".join(some)).encode().decode("latin-1").translate(_BYTES))
        self._between(out, rest, self.model, lambda some: " " + "\n ".join(some))
        for p in marked:
            word = p[:-1]
            out[p] = (known[word] if word in known else out[word]) + self.marks[p[-1]]
        return out


def _odd(piece: str) -> bool:
    """White space meets the space or line feed at this piece's ends."""
    inner = piece[1:] if piece[:1] == "\n" else piece
    return not inner or inner[0].isspace() or inner[-1].isspace()


def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return held(path, lambda: Encoder(path))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
