"""Byte-level BPE encoding and decoding of whole documents with the streaming transducer of byte_bpe."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from pollwarden.llm.byte_bpe import MergeList, StreamDecoder, Transducer, load_merges
from pollwarden.llm.common import documents, map_text

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of a text that are cut into pre-tokens at a time, and the longest pre-token that is remembered.
PIECE, REMEMBERED = 65_536, 128


class WordCache(dict):
    """Of a pre-token: number of tokens, their decimal form, their bytes; forgotten altogether when full."""

    def __init__(self, merges: MergeList, limit: int = 300_000):
        super().__init__()
        self.transducer, self.text, self.limit = Transducer(merges), merges.text, limit

    def __missing__(self, word: str) -> tuple[int, str, bytes]:
        ids, text = self.transducer.encode(word.encode()), self.text
        got = (len(ids), ",".join(map(str, ids)), b"".join([text[i] for i in ids]))
        if len(word) <= REMEMBERED:
            if len(self) >= self.limit:
                self.clear()
            self[word] = got
        return got


class ChunkCache(dict):
    """The same for what stands between two single spaces, the first space included; forgotten altogether when full."""

    def __init__(self, words: WordCache, find, limit: int = 300_000):
        super().__init__()
        self.words, self.find, self.limit = words, find, limit

    def __missing__(self, chunk: str) -> tuple[int, str, bytes]:
        core = chunk.rstrip(PUNCTUATION)
        if core.isalpha():  # letters: one pre-token; what ASCII punctuation follows is another
            got = self.words[" " + core]
            if core != chunk:
                n, shown, raw = self.words[chunk[len(core):]]
                got = (got[0] + n, got[1] + "," + shown, got[2] + raw)
        else:
            n, shown, raw = zip(*[self.words[w] for w in self.find(" " + chunk)])
            got = (sum(n), ",".join(shown), b"".join(raw))
        if len(chunk) <= REMEMBERED:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = got
        return got


def pieces(text: str, cut, size: int = PIECE) -> Iterator[str]:
    """Parts of a text that pre-token boundaries separate: a cut is a space between a non-space and a letter."""
    at = 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


def coder(merges: MergeList):
    """Function over texts that gives (tokens, hash of the ids, hash of the decoded text) for each."""
    import regex

    find = regex.compile(PATTERN).findall
    cut = regex.compile(r"(?<=\S) (?=\p{L})")
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")").split if merges.special else None
    loose = regex.compile(r" \s|\s ").search
    cache = WordCache(merges)
    chunks = ChunkCache(cache, find)

    def one(text: str) -> tuple[int, str, str]:
        n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder()
        lead = ""
        for part in split(text) if split else [text]:
            if split and part in merges.special:
                batches = [(1, str(merges.special[part]), part.encode())]
            else:
                batches = (tokens_of(piece) for piece in pieces(part, cut) if piece)
            for many, shown, raw in batches:
                ids_hash.update((lead + shown).encode())
                lead, n = ",", n + many
                text_hash.update(decoder.feed(raw).encode())
        text_hash.update(decoder.finish().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def tokens_of(piece: str) -> tuple[int, str, bytes]:
        """A space between two characters that are no spaces always begins a pre-token, so texts without other spaces are cut there first."""
        if loose(piece):
            got = [cache[w] for w in find(piece)]
        else:
            first, *rest = piece.split(" ")
            got = [*[cache[w] for w in find(first)], *[chunks[c] for c in rest]]
        n, shown, raw = zip(*got)
        return sum(n), ",".join(shown), b"".join(raw)

    return lambda texts: [one(t) for t in texts]


def with_tokens(docs: DataFrame, columns: list[str], path: str) -> DataFrame:
    """columns of docs and (n_tokens, ids_sha256, decoded_sha256); null counts as empty, which has no token. Other columns are not read.

    Rows are coded one by one, so repeated rows code alike and an empty table gives no rows. Very long texts are cut at pre-token borders
    and coded piece by piece. The vocabulary file is read on the driver
    and sent to the tasks (a file of fixed size).
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(path))

    def setup():
        merges = shared.value
        if merges.ready is None:  # a worker process that runs several tasks makes its automaton and its memory of pre-tokens once
            merges.ready = coder(merges)
        return merges.ready

    return map_text(docs, columns, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", None, setup=setup)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary, and the text they decode to."""
    return with_tokens(documents(spark, sf_dir), ["doc_id"], vocabulary_path("byte_bpe_50k.json"))
