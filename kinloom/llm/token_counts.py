"""Token counts by finite-state transducers.

Two transducers stand for a byte-level BPE tokenizer.  The first reads code
points and cuts a text into the pieces that the merges never cross; each of
its transitions tells how many pieces it begins.  Texts are cut into chunks,
every chunk is run from all states at once, the chunks' state maps compose in
a parallel prefix scan, and a last sweep from the states so found marks the
cuts.  The second reads the bytes of a piece; its states hold the tokens that
end inside the current token prefix, and each transition the change in the
number of tokens.  It is compiled on demand and kept.
"""

from __future__ import annotations

import gc
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.common import intake, outgo

# ---------------------------------------------------------------- pieces
#: Classes of code points: the letters that contractions need stand apart.
BLANK, SPACE, NUMBER, OTHER, QUOTE, LETTER, SHORT, REV, E, ELL, END = range(11)
#: States: at a fresh piece; in letters, numbers, others; white space of one
#: sign or of several, ending in a blank or not; after a quote that begins a
#: piece; after a quote and r or v; after a quote and l.
FRESH, LETTERS, NUMBERS, OTHERS, ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE, QUOTED, QUOTED_RV, QUOTED_L = range(11)
N_STATES = 11
#: What a transition begins: a piece at this sign, a piece at the sign before.
HERE, BEFORE = 1, 2
CHUNK = 256


def _compile_pieces() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begun pieces for every (class, state)."""
    to, out = np.zeros((11, N_STATES), np.uint8), np.zeros((11, N_STATES), np.uint8)
    letters = (LETTER, SHORT, REV, E, ELL)

    def home(c: int) -> int:
        if c in letters:
            return LETTERS
        return {BLANK: ONE_BLANK, SPACE: ONE_SPACE, NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, END: FRESH}[c]

    def plain(state: int, c: int) -> tuple[int, int]:
        stays = (state == LETTERS and c in letters) or (state == NUMBERS and c == NUMBER) or (state == OTHERS and c in (OTHER, QUOTE))
        return (state, 0) if stays else (home(c), HERE)

    for c in range(11):
        for state in (FRESH, LETTERS, NUMBERS, OTHERS):
            to[c, state], out[c, state] = plain(state, c)
        for state in (ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE):
            many, blank = state in (MANY_BLANK, MANY_SPACE), state in (ONE_BLANK, MANY_BLANK)
            if c in (BLANK, SPACE):
                to[c, state] = MANY_BLANK if c == BLANK else MANY_SPACE
            elif c == END:
                to[c, state], out[c, state] = FRESH, HERE
            else:
                joined = OTHERS if c == QUOTE else home(c)
                to[c, state] = joined if blank else home(c)
                out[c, state] = (BEFORE if many else 0) | (0 if blank else HERE)
        if c == SHORT:
            to[c, QUOTED] = FRESH
        elif c in (REV, ELL):
            to[c, QUOTED] = QUOTED_RV if c == REV else QUOTED_L
        elif c in (OTHER, QUOTE):
            to[c, QUOTED] = OTHERS
        else:
            to[c, QUOTED], out[c, QUOTED] = home(c), HERE
        for state, last in ((QUOTED_RV, E), (QUOTED_L, ELL)):
            if c == last:
                to[c, state] = FRESH
            else:
                to[c, state], more = plain(LETTERS, c)
                out[c, state] = more | BEFORE
    return to, out


TO, OUT = _compile_pieces()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        for signs, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", SHORT), ("rv", REV), ("e", E), ("l", ELL)):
            table[[ord(x) for x in signs]] = kind
        _classes = table
    return _classes


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps ``[chunk, state]`` under composition, in log steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, for classes that end with END."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    lanes = np.full(chunks * CHUNK, END, np.uint8)
    lanes[:n] = kinds
    lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
    flat_to, flat_out = TO.ravel(), OUT.ravel()
    base = lanes.astype(np.uint16) * N_STATES
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (chunks, 1))
    for t in range(CHUNK):
        maps = flat_to[base[t][:, None] + maps]
    entry = np.zeros(chunks, np.uint8)
    entry[1:] = compose_scan(maps)[:-1, FRESH]
    begun = np.empty((CHUNK, chunks), np.uint8)
    state = entry
    for t in range(CHUNK):
        at = base[t] + state
        begun[t] = flat_out[at]
        state = flat_to[at]
    flags = begun.T.ravel()[:n]
    here = (flags & HERE) != 0
    here[:-1] |= (flags[1:] & BEFORE) != 0
    return np.flatnonzero(here)


# ---------------------------------------------------------------- merges
def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTransducer:
    """Counts the tokens of a piece, one transition a byte."""

    #: Transitions and pieces are dropped and compiled again beyond these.
    MAX_STATES, MAX_PIECES = 200_000, 600_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        signs = _byte_signs()
        as_bytes = lambda s: bytes(signs[x] for x in s)
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        special = set(self.special)
        self.ids = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in special}
        self.tokens = {i: b for b, i in self.ids.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = as_bytes(a), as_bytes(b)
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.prefixes = {b[:k] for b in self.ids for k in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.pieces: dict[str, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self._number((b"", ((-1, 0),)))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a piece by the merges themselves."""
        ids, ranks = [self.ids[piece[i : i + 1]] for i in range(len(piece))], self.ranks
        none = 1 << 30, 0
        found = [ranks.get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get((ids[at - 1], ids[at]), none)
            if at < len(found):
                found[at] = ranks.get((ids[at], ids[at + 1]), none)
        return ids

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: the start of the piece)."""
        key = before, token
        if key not in self.pairs:
            if before < 0:
                self.pairs[key] = self.merged(self.tokens[token]) == [token]
            else:
                self.pairs[key] = self.merged(self.tokens[before] + self.tokens[token]) == [before, token]
        return self.pairs[key]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: the one token that can end here decides it."""
        suffix, ends = self.states[state]
        seen = suffix + bytes((byte,))
        for k in range(len(seen), 0, -1):
            token = self.ids.get(seen[-k:])
            if token is not None:
                before, count = ends[len(seen) - k]
                if self._fits(before, token):
                    break
        change = count + 1
        ends = (*ends, (token, change))
        keep = next(k for k in range(len(seen), -1, -1) if seen[len(seen) - k :] in self.prefixes)
        suffix = seen[len(seen) - keep :]
        # Only positions from which a longer token may still grow matter.
        live = ends[len(ends) - keep - 1 :]
        tail = tuple((x[0], x[1] - change) if x and suffix[k:] in self.prefixes else None for k, x in enumerate(live))
        step = self._number((suffix, tail)), change
        self.steps[state][byte] = step
        return step

    def count(self, piece: str) -> int:
        state = total = 0
        for byte in piece.encode():
            step = self.steps[state].get(byte)
            state, change = step or self._compile(state, byte)
            total += change
        return total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special token's string counts as one."""
        parts, owner, totals = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = [text]
            for special in self.special:
                cut = [x for part in cut for x in part.split(special)] if special in text else cut
            totals[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        joined = "\0".join(parts) + "\0"
        kinds = classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths) - 1
        kinds[ends] = END
        starts = piece_starts(kinds)
        if len(self.states) > self.MAX_STATES or len(self.pieces) > self.MAX_PIECES:
            self._reset()
        known, number = self.pieces, np.empty(len(starts), np.int64)
        stops = np.append(starts[1:], len(joined)).tolist()
        for k, (a, b) in enumerate(zip(starts.tolist(), stops)):
            piece = joined[a:b]
            n = known.get(piece)
            if n is None:
                n = known[piece] = self.count(piece)
            number[k] = n
        number[kinds[starts] == END] = 0
        first = np.searchsorted(starts, ends - lengths + 1)
        np.add.at(totals, np.array(owner), np.add.reduceat(number, first))
        return totals


_loaded: dict[str, BpeTransducer] = {}


def transducer(path: str) -> BpeTransducer:
    if path not in _loaded:
        _loaded[path] = BpeTransducer(path)
    return _loaded[path]


#: Texts are counted in groups of about this many code points.
GROUP = 2 << 20


def _counter(path: str):
    def run(text: pa.Array) -> pa.Array:
        machine, out, group, size = transducer(path), [], [], 0
        for one in text:
            group.append(one.as_py() or "")
            size += len(group[-1])
            if size >= GROUP:
                out.append(machine.counts(group))
                gc.freeze()  # the tables only grow; the collector need not walk them again
                group, size = [], 0
        if group:
            out.append(machine.counts(group))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``path`` names the vocabulary file of a byte-level BPE tokenizer, which
    every executor must see.  Null and empty texts have 0 bytes and tokens; a
    special token's string inside a text is one token.  All other columns stay,
    whatever their names and nulls; rows are independent, nothing is shuffled,
    repeated rows count alike and an empty table gives an empty one.  Texts of
    any length are counted whole.
    """
    base, names = intake(docs, text_col)
    tokens = base.withColumn("_n", _counter(path)(F.coalesce(F.col("_w0"), F.lit(""))))
    return outgo(
        tokens,
        names,
        {text_col: F.col("_w0"), "n_bytes": F.coalesce(F.octet_length("_w0"), F.lit(0)).cast("long"), "n_tokens": F.col("_n"), "over_limit": F.col("_n") > limit},
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
