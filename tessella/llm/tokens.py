"""Token ids of whole texts by a public tokenizer file, with a memo of words.

The file's model handles each pre-token on its own, so ids of a text are the
ids of its pre-tokens, one after the other. A memo over pre-tokens saves the
library most of its work. Only Latin words (LATIN) are split into pre-tokens
here; of other texts each stretch between ASCII white space that holds another
sign goes to the library as it is, so that no other Unicode version than the
library's own decides. Texts that hold a special token's string, and files of
another make, go to the library whole.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tessella.llm.common import TOKENIZER_FILE, map_rows, worker_cache

MEMO_WORDS = 400_000
GROUP = 64
# Words of these characters alone are split by a pattern of plain ranges: \\p{L} and \\p{N} are ranges there.
LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\x09-\x0d\x20a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Stretches between ASCII white space; the library parts words there, too.
STRETCH = re.compile("[^\\x09-\\x0d\\x20]+")
#: Before a stretch that the library encodes; no pre-token begins with white space.
WHOLE = "\n"
CLIP_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids, as a uint32 array."""

    def __init__(self, file: str = TOKENIZER_FILE):
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = file if "/" in file else public_tokenizers.path(file)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        split = [p for p in (model.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        steps = [n["type"] for n in (model.get("normalizer") or {}).get("normalizers", [])]
        #: Whether the file is of the make that words() knows.
        self.known = len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"] and steps == ["NFC", "Replace", "Lowercase"] and split[0]["pattern"]["Regex"] == CLIP_WORDS
        # The same model for pre-tokens that are normalised and split already.
        self.plain = Tokenizer.from_file(path)
        if self.known:
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = model["model"].get("end_of_word_suffix")
        self.final = self._final(model["model"]["vocab"], suffix) if suffix else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _final(vocab: dict[str, int], suffix: str) -> np.ndarray:
        flags = np.zeros(max(vocab.values()) + 4096, bool)
        flags[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return flags

    def _fill(self, words: set[str]) -> None:
        """Words of the older memo move to the newer; two calls for the rest, stretches and pre-tokens: the last id of a pre-token has the end-of-word suffix."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        rest = []
        for w in words:
            if (known := older.get(w)) is not None:
                memo[w] = known
            else:
                rest.append(w)
        stretches = [w for w in rest if self.final is None or w.startswith(WHOLE)]
        for w, e in zip(stretches, self.tokenizer.encode_batch([w.removeprefix(WHOLE) for w in stretches], add_special_tokens=False), strict=True):
            memo[w] = np.array(e.ids, "<u4").tobytes()
        rest = [w for w in rest if w not in memo]
        if not rest:
            return
        ids = np.array(self.plain.encode_batch_fast([" ".join(rest)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.final[ids]) + 1) * 4
        raw, at = ids.tobytes(), 0
        for w, to in zip(rest, ends.tolist(), strict=True):
            memo[w] = raw[at:to]
            at = to

    def words(self, text: str) -> list[str] | None:
        """The pre-tokens, and stretches marked by WHOLE; None if the whole text must go to the library."""
        if not self.known or any(s in text for s in self.special):
            return None
        if text.isascii() or LATIN.fullmatch(text):
            return LATIN_WORDS.findall(text.lower())
        out: list[str] = []
        for part in STRETCH.findall(text):
            out += LATIN_WORDS.findall(part.lower()) if LATIN.fullmatch(part) else [WHOLE + part]
        return out

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; words that the memo lacks are encoded together."""
        for k in range(0, len(texts), GROUP):
            group = texts[k : k + GROUP]
            split = [self.words(t or "") for t in group]
            flat = list(itertools.chain.from_iterable(x for x in split if x))
            if new := set(flat).difference(self.memo):
                self._fill(new)
            try:
                parts = list(map(self.memo.__getitem__, flat))
            except KeyError:  # the memo has just begun anew
                self._fill(set(flat).difference(self.memo))
                parts = list(map(self.memo.__getitem__, flat))
            at = 0
            for text, words in zip(group, split, strict=True):
                if words is None:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield np.frombuffer(b"".join(parts[at : at + len(words)]), "<u4")
                    at += len(words)

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.batch([text]))


def encoder(file: str = TOKENIZER_FILE) -> Encoder:
    """One encoder for each Python worker."""
    cache = worker_cache()
    if ("encoder", file) not in cache:
        cache["encoder", file] = Encoder(file)
    return cache["encoder", file]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(df: DataFrame, file: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids plus end_id, cut at capacity; only doc_id and text are read."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        enc = encoder(file)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(b["doc_id"], enc.batch(b["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    for name, v in zip(out, (doc, k, at, len(cut), crc(cut)), strict=True):
                        out[name].append(v)
            yield out

    return map_rows(df.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")
