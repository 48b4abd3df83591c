"""What can be proved about a byte-level BPE tokenizer file without any text.

``whole_tokens``: the vocabulary strings that the library encodes alone as one
token.

``ranks``: bytes and ids that a merge by rank may use in place of the library's
merge by listed pairs.  Both join the adjacent pair of the lowest rank, but the
first joins any pair that spells a token.  Let its first join of a pair that
isn't listed give the token t.  Until then both did the same inside t, and
nothing crossed t's ends, so the library, given t alone, would end with that
pair instead of t.  So both agree on all texts if the library joins every token,
given alone, to itself, and if tokens are listed in the order of their ids;
both are checked for the whole vocabulary.

``unproved``: a pattern for the characters whose class the library might see
otherwise than the pattern used here; texts that hold one go to the library.

All three only depend on the file.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: how this kind of tokenizer cuts text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Code points tried, first and last: Latin to Cyrillic, Hebrew, Arabic, the Indic and Thai blocks, general
# punctuation, symbols, kana, common Han characters, Hangul, full-width forms, pictographs.
TRIED = ((0x0000, 0x0E7F), (0x1E00, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FBF), (0xAC00, 0xD7BF), (0xFF00, 0xFFEF), (0x1F300, 0x1F6FF))
BLOCK = 64
# Characters of text whose pre-tokens are held at a time (one document at least).
GROUP_CHARS = 500_000
# Merged pre-tokens a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
# Pre-tokens of one long text that are held at a time.
HELD = 100_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies, and its byte.

    Visible Latin-1 characters stand for themselves; the other bytes take the
    characters from U+0100 on, in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def load(path: str) -> Tokenizer:
    """The tokenizer of a .json file; raises ValueError unless it is plain byte-level BPE."""
    if not path.endswith(".json"):
        raise ValueError(f"not a tokenizers file: {path}")
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    steps = parts.get("pre_tokenizer") or {}
    plain = steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space")
    if parts["model"]["type"] != "BPE" or parts["model"].get("dropout") or parts.get("normalizer") or not plain:
        raise ValueError(f"not a plain byte-level BPE: {path}")
    return Tokenizer.from_file(path)


def token_bytes(tokenizer: Tokenizer) -> dict[bytes, int]:
    """Bytes of every vocabulary entry but the added ones, with its id."""
    chars, added = byte_chars(), set(tokenizer.get_added_tokens_decoder())
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    return {bytes(chars[c] for c in token): i for token, i in vocabulary.items() if i not in added}


def added_strings(tokenizer: Tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


def whole_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and that the library encodes as the one token they spell, with its id."""
    found = []
    for spelled, i in token_bytes(tokenizer).items():
        try:
            found.append((spelled.decode("utf-8"), i))
        except UnicodeDecodeError:
            continue  # a part of a character, which no text spells alone
    encoded = tokenizer.encode_batch([s for s, _ in found], add_special_tokens=False)
    return {s: i for (s, i), e in zip(found, encoded) if e.ids == [i]}


def ranks(path: str, tokenizer: Tokenizer) -> dict[bytes, int]:
    """Bytes and id of every token, proved to merge by rank as the library merges; else ValueError."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    made = [vocabulary["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in merges]
    chars = {b: c for c, b in byte_chars().items()}
    tokens = token_bytes(tokenizer)
    in_order = all(a < b for a, b in zip(made, made[1:])) and len(tokens) == len(made) + 256 and all(tokens.get(bytes([b]), len(tokens)) < made[0] for b in range(256))
    alone = all([t.id for t in tokenizer.model.tokenize("".join(chars[b] for b in spelled))] == [i] for spelled, i in tokens.items())
    if not (in_order and alone):
        raise ValueError(f"merges of {path} can't be proved to follow the order of ids")
    return tokens


def word_end_ranks(path: str) -> tuple[dict[bytes, int], list[int]]:
    """Ranks that merge words as a vocabulary with word ends does, and the id of each rank; else ValueError.

    A word is its bytes and a zero byte, for words without one.  The last byte
    and the zero are joined first, being the vocabulary's last letter.  Merging
    by rank is proved as in ``ranks``, with the listed pairs merged here.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"not a BPE with word ends: {path}")
    chars = byte_chars()

    def spelled(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(chars[c] for c in token.removesuffix(suffix)) + b"\0" * end

    pairs = [tuple(spelled(t) for t in (pair if isinstance(pair, list) else pair.split(" "))) for pair in model["merges"]]
    listed = {pair: k for k, pair in enumerate(pairs)}
    made = [x + y for x, y in pairs]

    def alone(token: bytes) -> list[bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        if token.endswith(b"\0"):
            parts[-2:] = [token[-2:]]
        while len(parts) > 1:
            rank, at = min((listed.get(pair, len(listed)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(listed):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    if len(set(made)) < len(made) or any(b"\0" in m[:-1] for m in made) or any(alone(m) != [m] for m in made):
        raise ValueError(f"merges of {path} can't be proved to follow their order")
    letters = sorted(chars, key=chars.get)
    order = {bytes([chars[c]]): c for c in letters} | {bytes([chars[c]]) + b"\0": c + suffix for c in letters if chars[c]}
    tokens = [*order.values(), *["".join(pair) if isinstance(pair, list) else pair.replace(" ", "") for pair in model["merges"]]]
    return {t: k for k, t in enumerate([*order, *made])}, [model["vocab"][t] for t in tokens]


def unproved(agrees: Callable[[str], bool]) -> re.Pattern[str]:
    """Pattern for one character outside the blocks for which ``agrees`` holds.

    Pre-tokens depend on a character's class alone (letter, number, space or
    other), so a probe holds each character after a letter, a digit, a mark
    and a space.
    """
    ranges: list[list[int]] = []
    for low, high in TRIED:
        for first in range(low, high + 1, BLOCK):
            last = min(first + BLOCK - 1, high)
            if agrees("".join(f"a{c}1{c}!{c} {c}{c}\n" for c in map(chr, range(first, last + 1)))):
                if ranges and ranges[-1][1] == first - 1:
                    ranges[-1][1] = last
                else:
                    ranges.append([first, last])
    if not ranges:
        return re.compile(r"(?s:.)")
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


def same_pre_tokens(tokenizer: Tokenizer) -> Callable[[str], bool]:
    """Whether the library cuts a probe as ``PRE_TOKEN`` does."""
    pattern = regex.compile(PRE_TOKEN)

    def agrees(probe: str) -> bool:
        cuts = [probe[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return cuts == pattern.findall(probe)

    return agrees


class Encoder:
    """Token ids of texts: whole tokens are looked up, other pre-tokens merged by rank, each distinct one once.

    ``whole``, ``ranked`` and ``rest`` are what ``whole_tokens``, ``ranks`` and
    ``unproved`` found.  Special strings inside a text are single tokens, the library's default,
    or plain text if ``plain``.
    """

    def __init__(self, path: str, whole: dict[str, int], ranked: dict[bytes, int], rest: re.Pattern[str], plain: bool = False):
        self.library = load(path)
        merging = tiktoken.Encoding("proved", pat_str=PRE_TOKEN, mergeable_ranks=ranked, special_tokens={})
        self.merge_one = merging._core_bpe.encode_single_piece
        self.library.encode_special_tokens = plain
        self.cut = regex.compile(PRE_TOKEN)
        self.whole = {piece: array("I", [i]).tobytes() for piece, i in whole.items()}
        self.known = dict(self.whole)
        self.rest = rest
        added = added_strings(self.library)
        self.added = re.compile("|".join(map(re.escape, added))) if added and not plain else None

    def _merge(self, pieces: list[list[str]]) -> None:
        """Learn the ids of some pre-tokens."""
        rest = set().union(*pieces).difference(self.known)
        if len(self.known) + len(rest) > len(self.whole) + REMEMBERED:
            self.known = dict(self.whole)
            rest = set().union(*pieces).difference(self.known)
        for piece in rest:
            self.known[piece] = array("I", self.merge_one(piece.encode())).tobytes()

    def _long(self, text: str) -> bytes:
        out, cuts = [], (m[0] for m in self.cut.finditer(text))
        while pieces := list(islice(cuts, HELD)):
            self._merge([pieces])
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)

    def group(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit integers."""
        out, cuts = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            if self.rest.search(text) or self.added and self.added.search(text):
                out[i] = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            elif len(text) > GROUP_CHARS:
                out[i] = self._long(text)
            else:
                cuts[i] = self.cut.findall(text)
        self._merge(list(cuts.values()))
        for i, pieces in cuts.items():
            out[i] = b"".join(map(self.known.__getitem__, pieces))
        return out


def text_groups(texts: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts of about ``GROUP_CHARS`` characters; null is empty."""
    held: list[str] = []
    size = 0
    for value in texts:
        text = value.as_py() or ""
        if held and size + len(text) > GROUP_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def proof(path: str, plain: bool = False) -> tuple[dict[str, int], dict[bytes, int], re.Pattern[str]]:
    """What an ``Encoder`` of the file needs."""
    library = load(path)
    library.encode_special_tokens = plain
    return whole_tokens(library), ranks(path, library), unproved(same_pre_tokens(library))
