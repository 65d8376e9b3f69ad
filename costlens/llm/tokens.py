"""Token ids of whole batches of texts under a byte-level vocabulary.

A text is cut into words as the vocabulary's own pattern cuts it, and each different word of a
batch is encoded once.  The cut is done on byte arrays where that is plainly the same (letters of
the Latin blocks, ASCII digits, marks and white space, no apostrophe); any other text goes to the
library as a whole.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from .common import mix, utf8, BASE, BYTE_VALUES, powers

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks: encodes single words faster.
RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text encoded together: the larger, the fewer words are looked up again.
STEP = 1 << 20
#: Words whose ids a worker remembers; about 100 bytes each.
REMEMBERED = 200_000

#: Texts with anything else than these are left to the library.
_PLAIN = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ɏ]*").fullmatch

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER


class Encoder:
    """Ids by a public tokenizer file, no special tokens added.

    ``ranks`` must be the same vocabulary; ``path`` gives the ids of texts that aren't plain.  With
    ``plain_specials`` the name of a special token inside a text is ordinary text.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None, plain_specials: bool = False):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.tokenizer.encode_special_tokens = plain_specials
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        lines = Path(ranks or public_tokenizers.path(RANKS)).read_bytes().splitlines()
        self.words = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, special_tokens={},
            mergeable_ranks={base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)},
        )
        self.known: dict[bytes, bytes] = {}  # ids as 32-bit numbers one after another

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of plain texts."""
        n = len(data)
        kind = _KIND[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        edge = cut.copy()
        edge[1:n] |= kind[1:] != kind[:-1]
        edge = np.flatnonzero(edge)
        start, end = edge[:-1], edge[1:]
        last = cut[end]  # the run ends its text
        space = kind[start] == _SPACE
        # white space before a word: its last character stands alone or, if a blank, leads the word
        split = space & ~last
        lead = split & (data[end - 1] == 32)
        begins = np.where(~space & np.concatenate([[False], lead[:-1]]), start - 1, start)
        keep = ~split | (end - start > 1)  # white space before the last character
        tail = split & ~lead
        starts = np.concatenate([begins[keep], end[tail] - 1])
        ends = np.concatenate([np.where(split, end - 1, end)[keep], end[tail]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each."""
        strings = texts.to_pylist()
        plain = np.array(
            [s is not None and _PLAIN(s) is not None and not any(t in s for t in self.special) for s in strings], bool
        )
        data, bounds = utf8(texts.filter(pa.array(plain)))
        counts = np.zeros(len(strings), np.int64)
        pieces = {}
        for i in np.flatnonzero(~plain):
            if strings[i]:
                pieces[i] = self._whole(strings[i])
                counts[i] = len(pieces[i])
        ids = np.zeros(0, np.uint32)
        if len(data):
            starts, ends = self._words(data, bounds)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data))[: len(data)], out=sums[1:])
            value = mix((sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
            _, first, which = np.unique(value, return_index=True, return_inverse=True)
            raw = data.tobytes()
            if len(self.known) > REMEMBERED:
                self.known.clear()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            known, encode = self.known, self.words.encode_ordinary
            for word in words:
                if word not in known:
                    known[word] = np.array(encode(word.decode()), np.uint32).tobytes()
            each = [known[w] for w in words]
            size = np.array([len(e) for e in each], np.int64) // 4
            table, at = np.frombuffer(b"".join(each), np.uint32), np.cumsum(size) - size
            n = size[which]
            ids = table[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            per_text = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, bounds)]
            counts[plain] = np.diff(per_text)
        ends = np.cumsum(counts)
        if pieces:
            out = np.zeros(int(ends[-1]), np.uint32)
            mine = np.repeat(plain, counts)
            out[mine] = ids
            for i, piece in pieces.items():
                out[ends[i] - len(piece) : ends[i]] = piece
            ids = out
        return ids, np.concatenate([[0], ends])
