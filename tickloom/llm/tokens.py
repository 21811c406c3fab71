"""Token ids of whole texts by the tokenizers library, with the ids of known words kept."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa


class Encoder:
    """``encode`` equals the library's ``encode(text, add_special_tokens=False)`` for a byte-level BPE.

    Such a tokenizer never joins two words that a single space or line end separates, so each distinct word goes to
    the library once. A text with any other run of white space goes there whole. At most ``keep`` words stay."""

    def __init__(self, path: str, keep: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.keep = Tokenizer.from_file(path), keep
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(size, bool)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")
        self.line_end = self.raw("\n")
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, known: dict, words: set[str], lead: str) -> None:
        new = words - known.keys()
        if not new:
            return
        whole = "x".join(new)
        if lead and "" not in new and "<|" not in whole and len(whole.split()) == 1 and not whole[0].isspace() and not whole[-1].isspace() and max(map(len, new)) <= 200:
            plain = list(new)
        else:
            plain = []
            for w in new:
                if not w or w[0].isspace() or w[-1].isspace():
                    known[w] = None
                elif "<|" in w or len(w) > 200 or len(w.split()) > 1 or not lead:
                    known[w] = self.raw(lead + w)
                else:
                    plain.append(w)
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.lib.encode_batch_fast([lead + lead.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(group):
                data, width = ids.tobytes(), self.kind.itemsize
                begins = (at * width).tolist()
                known.update(zip(group, map(data.__getitem__, map(slice, begins, [*begins[1:], len(data)]))))
            else:
                known.update((w, self.raw(lead + w)) for w in group)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and size < 4_000_000:
                size += len(texts[j])
                j += 1
            out += self._some(texts[i:j])
            i = j
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > self.keep:
            self.first, self.later = {}, {}
        split = [[line.split(" ") for line in t.split("\n")] if t else [] for t in texts]
        first, later = set(), set()
        for lines in split:
            for words in lines:
                first.add(words[0])
                later.update(words[1:])
        self._learn(self.first, first, "")
        self._learn(self.later, later, " ")
        a, b, out = self.first, self.later.__getitem__, []
        for text, lines in zip(texts, split):
            try:
                out.append(self.line_end.join([a[w[0]] + b"".join(map(b, w[1:])) for w in lines]))
            except TypeError:
                out.append(self.raw(text))
        return out


def encoder(path: str) -> Encoder:
    """One for each file and worker process. It is kept under ``sys.modules``: functions travel to workers by value, so a
    global of this module would begin anew with each task."""
    kept = sys.modules.setdefault("tickloom_encoders", types.ModuleType("tickloom_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def forget() -> None:
    """Gives back what the encoders of this worker process keep; for operators that don't encode and may follow one that does."""
    if sys.modules.pop("tickloom_encoders", None):
        pa.default_memory_pool().release_unused()


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
