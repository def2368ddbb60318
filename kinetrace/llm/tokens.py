"""Ids of public tokenizers inside Spark tasks, with a bounded cache of words that lives as long as the Python worker."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from kinetrace.llm.workspace import cached, working_on

#: Words that one Python worker remembers, and as many again that it has not met since; longer words are not remembered.
CACHE_WORDS, LONGEST = 300_000, 64
#: Code points that are encoded at once, words in one text that the library gets.
RUN, JOINED = 250_000, 256
A_TO_Z = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Marks that are split from the words before them where no two marks stand together.
SPLIT = [b".", b",", b";", b":", b"!", b"?"]
LETTER, DIGIT, MARK = 1, 2, 3
#: What the Latin-1 characters are to the tokenizer; 0 for white space.
LATIN_1 = np.array([LETTER if chr(c).isalpha() else DIGIT if chr(c).isnumeric() else MARK if c not in (*range(9, 14), 32, 133, 160) else 0 for c in range(256)], np.uint8)
KINDS, TWO_MARKS = LATIN_1.tobytes(), bytes([MARK, MARK])
#: Words that go to the library as they are: with white space, apostrophes, special strings or characters beyond Latin-1.
OTHER = re.compile(r"[^!-&(-~\x7f-\x84\x86-\x9f\xa1-\xff]|<\|")

_loaded: dict[str, "WordTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_spaces(config: dict) -> bool:
    """Whether a tokenizer composes, lower-cases, drops white space and splits letters, digits and other marks before it merges."""
    normalisers = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
    return (
        normalisers == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        and splits[0].get("behavior") == "Removed"
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in config.get("added_tokens", []))
        and config["model"].get("end_of_word_suffix") is not None
    )


class WordTokenizer:
    """Encodes texts with the tokenizers library, each distinct word once while it is remembered.

    A tokenizer that ``drops_spaces`` merges nothing across a space or a line feed, so the ids of a text are those of its words in order. In texts of
    Latin-1 characters, with which no mark is composed, A-Z are lower-cased first and single marks split from words; new words of such characters are
    lower-cased, and then parted and merged by the library many at a time. All other words go to the library as they are. Other tokenizers, and all
    with ``whole=True``, get whole texts.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        config = json.loads(self.tokenizer.to_str())
        self.whole = whole or not drops_spaces(config)
        if not self.whole:
            # the same model without normalisation, for words that are normalised already
            self.prepared = Tokenizer(self.tokenizer.model)
            self.prepared.pre_tokenizer = self.tokenizer.pre_tokenizer
            self.last = np.zeros(self.size, bool)
            suffix = config["model"]["end_of_word_suffix"]
            self.last[[i for piece, i in config["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.recent: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_prepared(self, words: list[str]) -> list[bytes] | None:
        """Words of Latin-1 characters without apostrophes, all at once: every part of a word ends with its only id that may end one.

        None if the parts are not as many as expected.
        """
        text = " ".join(words).lower()
        kinds = LATIN_1[np.frombuffer(text.encode("latin-1"), np.uint8)]
        # runs of letters and of marks are parts, and so is each digit
        part = (kinds > 0) & (np.diff(kinds, prepend=0) != 0) | (kinds == DIGIT)
        gaps = np.flatnonzero(kinds == 0)
        upto = np.append(np.cumsum(part)[gaps], part.sum())
        cuts = np.append(gaps[JOINED - 1 :: JOINED], len(text)).tolist()
        runs = [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in self.prepared.encode_batch_fast(runs, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != upto[-1]:
            return None
        at = np.append(0, ends)[upto] * self.dtype.itemsize
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]

    def _learn(self, missing: list[str]) -> None:
        """Have these words in ``recent``."""
        own, former = self.recent, self.former
        held = [w for w in missing if w in former]
        own.update(zip(held, map(former.__getitem__, held), strict=True))
        missing = list(set(missing).difference(held))
        if OTHER.search(" ".join(missing)):
            odd = [w for w in missing if OTHER.search(w)]
            own.update(zip(odd, self._encode(odd), strict=True))
            missing = list(set(missing).difference(odd))
        if missing:
            own.update(zip(missing, self._encode_prepared(missing) or self._encode(missing), strict=True))

    def _words(self, text: str) -> list[str]:
        try:
            raw = text.encode("latin-1").replace(b"\n", b" ")
        except UnicodeEncodeError:  # marks may be composed with capital letters in other ways than with small ones
            return text.replace("\n", " ").split(" ")
        if TWO_MARKS not in raw.translate(KINDS):  # a single mark is a part of its own
            raw = raw.translate(A_TO_Z)
            for mark in SPLIT:
                raw = raw.replace(mark, b" " + mark)
        elif b"<|" not in raw:  # special strings are told apart before letters are lower-cased
            raw = raw.translate(A_TO_Z)
        return raw.decode("latin-1").split(" ")

    def _run(self, texts: list[str]) -> list[bytes]:
        if len(self.recent) > CACHE_WORDS:
            self.recent, self.former = {}, self.recent
        self.recent[""] = b""
        words = [self._words(t) for t in texts]
        missing = set().union(*[set(w).difference(self.recent) for w in words])
        self._learn(list(missing))
        out = [b"".join(map(self.recent.__getitem__, w)) for w in words]
        for word in [w for w in missing if len(w) > LONGEST]:
            del self.recent[word]
        return out

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """The ids of each text as packed little-endian integers of ``dtype``, with ``end`` behind them."""
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        if self.whole:
            return [x + tail for x in self._encode(texts)]
        out, k = [], 0
        while k < len(texts):
            first, n = k, 0
            while k < len(texts) and n < RUN:
                n, k = n + len(texts[k]), k + 1
            out += [ids + tail for ids in self._run(texts[first:k])]
        return out


def load(path: str, whole: bool = False) -> WordTokenizer:
    working_on("tokens")
    key = f"{path}:{whole}"
    if key not in _loaded:
        _loaded[key] = WordTokenizer(path, whole)
    return _loaded[key]


cached(_loaded.clear)
