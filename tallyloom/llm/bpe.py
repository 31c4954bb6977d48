"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes a token of the vocabulary, so two neighbouring symbols that occur side by side
inside no token stay apart for certain.  Each word is cut at such pairs, the fragments are encoded
independently, and their ids are concatenated: the result equals that of encoding the word at once.
Fragments repeat far more than words do, and both are remembered in bounded tables.

The codec follows a vocabulary file of the ``tokenizers`` library with the steps that ``word_bpe_49k.json``
names: special tokens found in the raw text, NFC, white space to blanks, lower case by character, split into
words, bytes as characters, merges with a word-end suffix.  A file that names other steps is refused.  As
the file has no decoder, decoding joins the tokens by a blank, as the library does.

Defined results: null is encoded as the empty text (no ids, empty decoded text); repeated rows come back
each; an empty table gives an empty result; only the id and the text are read, so extra columns can't
clash.  Long texts are encoded word by word; a word of any length is cut into fragments.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tallyloom.llm.common import values

#: Entries that each of two generations of a worker's table holds: of runs between blanks, of words, of fragments.
REMEMBERED = (150_000, 100_000, 20_000)
#: Texts of these characters alone are split here: Latin, Greek, Cyrillic, common punctuation.  The blanks among
#: them are those of ``str.split``.
_COMMON = regex.compile(r"[\x00-\x1b\x20-\u052f\u2010-\u2027\u2030-\u205e\u20ac]*")


def _supported(spec: dict) -> str | None:
    """The word pattern of a file whose steps this codec follows, else None."""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [(p["type"], p.get("behavior"), p.get("invert")) for p in parts]
    model = spec["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or steps != ["NFC", "Replace", "Lowercase"] or kinds != [("Split", "Removed", True), ("ByteLevel", None, None)] or spec.get("decoder"):
        return None
    return parts[0]["pattern"]["Regex"]


class Memory:
    """A bounded table: a full young generation takes the place of the old one, so frequent keys stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


def _byte_characters() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], _supported(spec)
        if split is None:
            raise ValueError(f"{path}: only normalising word BPE without a decoder is supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        # the merge engines: without a cache of their own, one for the end of a word and one for all before it
        self._last = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix or None, cache_capacity=0)
        self._inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(split)
        # tables of character classes differ between Unicode versions: other scripts go by the library's
        self._library = Tokenizer.from_file(path)
        self._byte = _byte_characters()
        self._back = {c: b for b, c in enumerate(self._byte)}
        # symbols side by side inside some token: all other pairs force a cut
        self.inside = {pair for t in self.vocab for s in [self._symbols(t)] for pair in zip(s, s[1:])}
        self._run, self._word, self._fragment = map(Memory, REMEMBERED)

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def fragments(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Runs of symbols between forced boundaries."""
        cuts = [i for i in range(1, len(symbols)) if (symbols[i - 1], symbols[i]) not in self.inside]
        return [tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)])]

    def merge(self, symbols: Sequence[str], last: bool) -> list[str]:
        """Tokens of one fragment, merged by the library's engine; the last one of a word has the suffix."""
        return [t.value for t in (self._last if last else self._inner).tokenize("".join(symbols))]

    def _tokens(self, word: str) -> list[str]:
        """Tokens of one word, given as characters that stand for its bytes."""
        symbols = list(word)
        if self.suffix:
            symbols[-1] += self.suffix
        parts = self.fragments(symbols)
        if len(parts) == 1:
            return self.merge(word, True)
        out: list[str] = []
        for part in parts[:-1]:
            found = self._fragment.get(part)
            if found is None:
                found = self.merge(part, False)
                self._fragment.put(part, found)
            out += found
        tail = len(parts[-1])
        return out + self.merge(word[len(word) - tail :], True)

    def _known(self, word: str) -> tuple[str, str]:
        """Ids and tokens of a normalised word, each joined by blanks."""
        found = self._word.get(word)
        if found is None:
            t = self._tokens("".join([self._byte[b] for b in word.encode("utf-8", "replace")]))
            found = " ".join([str(self.vocab[x]) for x in t]), " ".join(t)
            self._word.put(word, found)
        return found

    def _known_run(self, run: str) -> tuple[str, str]:
        """The same for a run of characters between blanks: no word reaches over a blank."""
        found = self._run.get(run)
        if found is None:
            pairs = [self._known(w) for w in self._words.findall(run)]
            found = pairs[0] if len(pairs) == 1 else (" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs]))
            self._run.put(run, found)
        return found

    def _pairs(self, text: str) -> list[tuple[str, str]]:
        if _COMMON.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # by character: no final sigma
            young = self._run.young.get
            return [young(r) or self._known_run(r) for r in text.lower().split()]
        normal = self._library.normalizer.normalize_str(text)
        words = [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]
        return [self._known(bytes(map(self._back.__getitem__, w)).decode("utf-8", "replace")) for w in words]

    def _encoded(self, text: str) -> tuple[list[str], list[str]]:
        """Ids and tokens of the text's pieces, each joined by blanks."""
        pairs: list[tuple[str, str]] = []
        for k, part in enumerate(self._specials.split(text) if self._specials and "<|" in text else [text]):
            pairs += [(str(self.special[part]), part)] if k % 2 else self._pairs(part)
        return [p[0] for p in pairs], [p[1] for p in pairs]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self._encoded(text or "")[0] for i in x.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids if i in self.token])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text; decoding reuses each word's tokens."""
        ids, tokens = self._encoded(text or "")
        joined = " ".join(ids)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return joined.count(" ") + 1 if joined else 0, sha(joined), sha(" ".join(tokens))


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    return Codec(path)


def encoded(text: Column, path: str) -> Column:
    """``array<int>`` of ids."""
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.encode(t) for (t,) in values(texts)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>").asNondeterministic()(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids."""
    def run(rows: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(r or []) for (r,) in values(rows)], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(ids)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row."""
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        rows = [c.digest(t) for (t,) in values(texts)]
        kinds = ((0, pa.int64()), (1, pa.string()), (2, pa.string()))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], ["n_tokens", "ids_sha256", "decoded_sha256"])

    udf = F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>").asNondeterministic()
    return docs.select(F.col(id_col), udf(F.col(text_col).cast("string")).alias("d")).select(id_col, "d.*")
