"""Where a byte-level tokenizer's pattern cuts text, found by scanning, without a regex.

Fixed values, the pattern that is reproduced:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point becomes a symbol (its class and as much of what follows as the pattern looks
at). A small automaton reads symbols and says at each whether a piece starts. Its transition
functions form a finite monoid, so runs of symbols compose associatively: blocks of text are
reduced side by side to one function each, the block functions are scanned, and a second
sweep over all blocks at once, each from its own entry state, marks the starts.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

# Symbols.
_LETTER, _FINAL, _FIRST, _NUMBER, _OTHER, _QUOTE, _PREFIX, _LAST_SPACE, _SPACE, _RESET = range(10)
# States: nothing open; in a run of letters, numbers, others; a space that may be a prefix;
# in white space; a quote that opened a piece; a quote and the first of two letters.
_NONE, _LETTERS, _NUMBERS, _OTHERS, _OPEN_SPACE, _SPACES, _AFTER_QUOTE, _HALF = range(8)
_BLOCK = 128


@lru_cache(1)
def class_table() -> bytes:
    """Class of each code point (0 other, 1 letter, 2 number, 3 white space), compressed.

    Read off the tokenizer library's own character classes once, so that its version of
    Unicode is the one used.
    """
    import tiktoken

    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    table = np.zeros(0x110000, np.uint8)
    for number, pattern in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1):
        only = tiktoken.Encoding(f"class{number}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = only.decode_bytes(only.encode_ordinary(text)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = number
    return zlib.compress(table.tobytes())


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the symbol starts a piece) by state and symbol."""
    goes = {
        _LETTER: _LETTERS, _FINAL: _LETTERS, _FIRST: _LETTERS, _NUMBER: _NUMBERS, _OTHER: _OTHERS, _QUOTE: _AFTER_QUOTE,
        _PREFIX: _OPEN_SPACE, _LAST_SPACE: _NONE, _SPACE: _SPACES, _RESET: _NONE,
    }
    continued = {(_SPACES, _SPACE): _SPACES, (_AFTER_QUOTE, _FINAL): _NONE, (_AFTER_QUOTE, _FIRST): _HALF}
    for letter in (_LETTER, _FINAL, _FIRST):
        continued |= {(_LETTERS, letter): _LETTERS, (_OPEN_SPACE, letter): _LETTERS, (_HALF, letter): _NONE}
    for state in (_NUMBERS, _OPEN_SPACE):
        continued[state, _NUMBER] = _NUMBERS
    for state in (_OTHERS, _OPEN_SPACE, _AFTER_QUOTE):
        continued |= {(state, _OTHER): _OTHERS, (state, _QUOTE): _OTHERS}
    follow, starts = np.zeros((8, 10), np.uint8), np.ones((8, 10), bool)
    for state in range(8):
        for symbol in range(10):
            follow[state, symbol] = continued.get((state, symbol), goes[symbol])
            starts[state, symbol] = (state, symbol) not in continued
    return follow, starts


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(follow, starts, function of each symbol and compositions, images) of the automaton."""
    follow, starts = _automaton()
    functions = [tuple(range(8))]
    number = {functions[0]: 0}
    generators = [tuple(int(s) for s in follow[:, symbol]) for symbol in range(10)]
    for f in functions:  # grows while it is read
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    size = len(functions)
    compose = np.empty((size, size), np.uint16)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i, j] = number[tuple(g[s] for s in f)]
    return follow, starts, compose, np.array([[number[g] for g in generators]], np.uint16)


def _functions_image() -> np.ndarray:
    """State reached from no open piece, by number of the function."""
    follow, _, compose, generators = _monoid()
    image = np.zeros(len(compose), np.uint8)
    seen, frontier = {0}, [(0, 0)]
    while frontier:
        f, state = frontier.pop()
        image[f] = state
        for symbol in range(10):
            g = int(compose[f, generators[0, symbol]])
            if g not in seen:
                seen.add(g)
                frontier.append((g, int(follow[state, symbol])))
    return image


_image = lru_cache(1)(_functions_image)


def _prefixes(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of all functions before each one, by doubling steps."""
    upto, step = functions.copy(), 1
    while step < len(upto):
        upto[step:] = compose[upto[:-step], upto[step:]]
        step *= 2
    return np.concatenate((np.zeros(1, upto.dtype), upto[:-1]))


def starts_of(symbols: np.ndarray) -> np.ndarray:
    """Whether each symbol starts a piece."""
    follow, starts, compose, generators = _monoid()
    n = len(symbols)
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, _RESET, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    step = np.ascontiguousarray(compose[:, generators[0]]).ravel()  # function after one more symbol
    whole = np.zeros(rows, np.uint16)
    for column in columns:
        whole = step[whole * np.uint16(10) + column]
    state = _image()[_prefixes(whole, compose)]
    out = np.empty((_BLOCK, rows), bool)
    follow, starts = follow.ravel(), starts.ravel()
    for i, column in enumerate(columns):
        at = state * np.uint8(10) + column
        out[i] = starts[at]
        state = follow[at]
    return out.T.ravel()[:n]


def symbols_of(points: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``ends`` are the places of the separators after each text."""
    kinds = table[points]
    kinds[ends] = 4
    following = np.empty_like(kinds)
    following[:-1], following[-1] = kinds[1:], 4
    symbols = np.array([_OTHER, _LETTER, _NUMBER, _SPACE, _RESET], np.uint8)[kinds]
    last = np.nonzero((kinds == 3) & (following != 3) & (following != 4))[0]
    symbols[last] = np.where(points[last] == 32, _PREFIX, _LAST_SPACE)
    quotes = np.nonzero((points == 39) & (kinds == 0))[0]
    symbols[quotes] = _QUOTE
    # Only the letters after a quote can end a contraction.
    after = quotes[quotes + 1 < len(points)] + 1
    after = after[kinds[after] == 1]
    first, second = points[after], points[np.minimum(after + 1, len(points) - 1)]
    symbols[after[np.isin(first, [ord(c) for c in "stmd"])]] = _FINAL
    pairs = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    symbols[after[pairs & (kinds[np.minimum(after + 1, len(points) - 1)] == 1)]] = _FIRST
    return symbols


def pieces(texts: Sequence[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and the number of pieces up to the end of each text."""
    if not texts:
        return [], np.zeros(0, np.int64)
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    begins = starts_of(symbols_of(points, ends, table))
    begins[ends] = True
    cuts = np.nonzero(begins)[0]
    kept = np.ones(len(points), bool)
    kept[ends] = False
    real = kept[cuts]
    upto = np.cumsum(real)[np.searchsorted(cuts, ends)]
    stops = np.append(cuts[1:], len(points))[real].tolist()
    return [joined[i:j] for i, j in zip(cuts[real].tolist(), stops)], upto


def load_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
