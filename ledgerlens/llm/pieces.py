"""Tokenizes many short chunks with a library tokenizer's own model.

Chunks of printable ASCII and Latin letters pass the normaliser and the splitter of the two supported
tokenizers in a way that a plain pattern describes; their pieces go to the tokenizer's model in one
call. All other chunks take the library's whole path. Both give the library's ids.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap
from collections.abc import Iterable

import numpy as np

#: Printable ASCII, and the letters of Latin-1 and Latin Extended-A that lower-case to one letter.
SIMPLE = re.compile(r"[ -~À-ÖØ-öø-\u012f\u0131-ſ]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")
BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-ZÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sa-zA-Z0-9À-ÖØ-öø-ſ]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """``words``: white space is dropped and case folded (a last token has the end-of-word mark)."""

    def __init__(self, path: str, words: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.words = words
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        self.pattern, self.fold = (WORD, str.lower) if words else (BYTE, str)
        vocabulary = self.whole.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # letters that a token covers
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix("</w>") if words else token)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def simple(self, chunk: str) -> bool:
        return SIMPLE.fullmatch(chunk) is not None and not ("<|" in chunk and any(s in chunk for s in self.special))

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids, as little-endian u32, of pieces that the splitter leaves whole."""
        out: list[bytes] = []
        for s in range(0, len(pieces), 2048):
            part = [p if p.isascii() and p[0] != " " else p.encode().decode("latin-1").translate(self.letters) for p in pieces[s : s + 2048]]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p) for p in part])) * 4 + 4
            at = [0, *ends.tolist()]
            out += [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        return out

    def flat(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks, chunk after chunk in some order, with each chunk's start and number of ids."""
        plain: list[str] = []
        sizes = np.zeros(len(chunks), np.int64)
        odd: list[int] = []
        fold, find = self.fold, self.pattern.findall
        all_simple = SIMPLE.fullmatch("".join(chunks)) is not None and "<|" not in "".join(chunks)
        for i, c in enumerate(chunks):
            if not all_simple and not self.simple(c):
                odd.append(i)
            elif c.isalpha():
                plain.append(fold(c))
                sizes[i] = 1
            else:
                pieces = find(fold(c))
                plain += pieces
                sizes[i] = len(pieces)
        ids, ends = [], [np.zeros(1, np.int64)]
        for s in range(0, len(plain), 2048):
            part = [p if p.isascii() and p[0] != " " else p.encode().decode("latin-1").translate(self.letters) for p in plain[s : s + 2048]]
            ids.append(np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32))
            ends.append(np.searchsorted(np.cumsum(self.sizes[ids[-1]]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))) + 1 + ends[-1][-1])
        at = np.concatenate(ends)
        last = np.cumsum(sizes)
        start = at[last - sizes]
        count = at[last] - start
        total = int(at[-1])
        for s in range(0, len(odd), 1024):
            for i, e in zip(odd[s : s + 1024], self.whole.encode_batch_fast([chunks[i] for i in odd[s : s + 1024]], add_special_tokens=False), strict=True):
                ids.append(np.array(e.ids, np.uint32))
                start[i], count[i] = total, len(ids[-1])
                total += len(ids[-1])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), start, count

    def encode(self, chunks: Iterable[str], known: dict[str, bytes], longest: int = 1 << 30) -> list[bytes]:
        """Ids of each chunk, as little-endian u32; ``known`` holds pieces seen before, and gets new ones of up to ``longest``."""
        chunks = list(chunks)
        every = "".join(chunks)
        all_simple = SIMPLE.fullmatch(every) is not None and "<|" not in every
        fold, find = self.fold, self.pattern.findall
        split: list[list[str] | None] = []
        for c in chunks:
            if not all_simple and not self.simple(c):
                split.append(None)
            elif c.isalpha() or c[:1] == " " and c[1:].isalpha() and not self.words:
                split.append([fold(c)])
            else:
                split.append(find(fold(c)))
        odd = [c for c, p in zip(chunks, split, strict=True) if p is None]
        whole = iter([np.array(e.ids, "<u4").tobytes() for s in range(0, len(odd), 1024) for e in self.whole.encode_batch_fast(odd[s : s + 1024], add_special_tokens=False)])
        new = list({x for p in split if p for x in p}.difference(known))
        brief = [x for x in new if len(x) <= longest]
        known.update(zip(brief, self.ids_of_pieces(brief), strict=True))
        if len(brief) < len(new):
            long = [x for x in new if len(x) > longest]
            known = ChainMap(dict(zip(long, self.ids_of_pieces(long), strict=True)), known)
        return [next(whole) if p is None else known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in split]
